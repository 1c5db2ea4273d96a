import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ridgeline.llm import common, components, embedding_dedup, exact_dedup, line_dedup, simhash, simhash_near

from llm_helpers import WORD, frame, lower, odd_rows


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[squeezed(t)].append((-len(t or ""), i is None, i or 0, i))
    return {(i, hashlib.sha256(squeezed(t).encode()).hexdigest()): (min(groups[squeezed(t)])[3], len(groups[squeezed(t)])) for i, t in rows}


def as_dict(out):
    return {(r.doc_id, bytes(r.digest).hex()): (r.keep_id, r.group_size) for r in out.collect()}


def test_exact_dedup(odd, empty):
    out = exact_dedup.exact_dedup(odd.withColumn("keep", F.lit("x")).withColumn("norm", F.lit(1)).withColumn("salts", F.lit(2)).withColumn("_RL_raw", F.lit(3)).withColumn("a.b", F.lit(4)))
    assert out.count() == len(odd_rows()) and "lang" in out.columns
    assert as_dict(out) == brute_exact(odd_rows())
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out.collect())
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_verifies_bytes(spark):
    """A digest that collides everywhere still gives the right groups."""
    rows = [(i, f"text {i % 5}" + " " * (i % 3)) for i in range(40)]
    weak = lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 1))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(frame(spark, rows), digest=weak).collect()}
    assert got == {i: v for (i, _), v in brute_exact(rows).items()}


@pytest.mark.parametrize("weak,fanout,bits", [(False, 2, 1 << 15), (True, 8, 1 << 27)])
def test_digest_runs_over_batches(spark, monkeypatch, weak, fanout, bits):
    """Batches against one index: as a brute-force grouping of all rows so far, also with
    a digest that collides within and across batches."""
    monkeypatch.setattr(exact_dedup, "FANOUT", fanout)
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    monkeypatch.setattr(common, "MEET_ROWS", 2)
    index = exact_dedup.DigestIndex(spark)
    short = lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 1))
    seen = []
    for ids in (range(100, 160), range(50, 80), [3, None], range(60)):
        batch = [(i, f"t{(i or 0) % 37}" + " " * ((i or 0) % 3)) for i in ids]
        seen += batch
        out = exact_dedup.exact_dedup(frame(spark, batch), index=index, digest=short if weak else exact_dedup.sha256).collect()
        want = {i: v for (i, _), v in brute_exact(seen).items()}
        assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in out) == sorted((str(i), *want[i]) for i, _ in batch)
    assert len(index.runs) == (4 if fanout == 8 else 1) and index.written > 3


def test_batches_with_one_digest_are_told_apart(spark):
    index = exact_dedup.DigestIndex(spark)
    same = lambda c: F.when(c.isNotNull(), F.unhex(F.lit("AB")))
    for batch in ([(1, "alpha"), (2, "alpha")], [(3, "gamma"), (4, "delta")]):
        out = exact_dedup.exact_dedup(frame(spark, batch), index=index, digest=same).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out) == [(3, 3, 1, True), (4, 4, 1, True)]


def test_exact_dedup_query_consults_its_runs(spark, data, odd, monkeypatch):
    """The query flushes batches, looks hits up in older runs and merges runs; batches do
    not change what is found."""
    found, merged, lookup, compact = [], [], exact_dedup.DigestIndex.lookup, exact_dedup.DigestIndex.compact
    monkeypatch.setattr(exact_dedup.DigestIndex, "lookup", lambda self, digests: found.append((len(self.runs), lookup(self, digests))) or found[-1][1])
    monkeypatch.setattr(exact_dedup.DigestIndex, "compact", lambda self: merged.append(compact(self)) or merged[-1])
    out = exact_dedup.op8_exact_dedup(spark, data)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size) for r in out.collect()} == brute_exact(docs)
    assert [n for n, _ in found] == [0, 1, 2, 1] and len(merged) == 1
    assert sum(rows.count() for n, rows in found if n) > 0
    assert as_dict(exact_dedup.exact_dedup(odd, index=exact_dedup.DigestIndex(spark, fanout=2), batches=3)) == brute_exact(odd_rows())


def test_filters_pass_what_they_hold(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    bits = exact_dedup.filter_bits(3000)
    stored = exact_dedup.make_filter(keys, bits)
    assert exact_dedup.passing(keys, F.col("h"), stored, bits).count() == 3000
    others = spark.range(3000, 23_000).select(F.xxhash64("id").alias("h"))
    assert exact_dedup.passing(others, F.col("h"), stored, bits).count() < 2500
    assert exact_dedup.filter_bits(10**12) == common.FILTER_BITS


def test_line_dedup_templates(spark, empty):
    rows = [
        (1, "Posted on 2020-01-02 by the admin team\nA first line of its own words"),
        (2, "Posted on 2021-11-30 by the admin team\nSecond text with other own words"),
        (3, "Dear Anna Smith we thank you for your kind order today\nshort one"),
        (4, "Dear Anna Jones we thank you for your kind order today\nshort one"),
        (5, None),
        (6, ""),
        (7, "Posted on 2020-01-02 by the admin team"),
        (8, "twice in one document only here\ntwice in one document only here"),
        (8, "twice in one document only here\ntwice in one document only here"),
        (None, "Posted on 1999-01-01 by the admin team\nthe rest stays where it is"),
    ]
    docs = frame(spark, rows).withColumn("leaf", F.lit("clash")).withColumn("N_LINES", F.lit(0))
    out = {(r.doc_id, r.text): r for r in line_dedup.line_dedup(docs, depth=2).collect()}
    text = {k[0]: k[1] for k in out}
    assert text[1] == rows[0][1] and text[2] == "Second text with other own words"
    assert text[3] == rows[2][1] and text[4] == ""
    assert text[5] is None and text[6] == "" and text[7] == "" and text[8] == rows[7][1]
    assert text[None] == "the rest stays where it is"
    emptied = {k[0] for k, r in out.items() if r.emptied}
    assert emptied == {4, 7}
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_keeps_unlike_lines_of_a_leaf(spark):
    rows = [(i, f"one two three {'abcdefgh'[i]}a {'abcdefgh'[i]}b {'abcdefgh'[i]}c {'abcdefgh'[i]}d") for i in range(8)]
    assert line_dedup.line_dedup(frame(spark, rows)).filter("n_dropped > 0").count() == 0


@pytest.mark.parametrize("meet_rows", [1000, 3])
def test_line_dedup_finds_families_in_a_mixed_leaf(spark, monkeypatch, meet_rows):
    """Two families and unlike lines share a leaf; keys of many rows take the other path."""
    monkeypatch.setattr(common, "MEET_ROWS", meet_rows)
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    lines = [f"We would like to thank {word(i)} for the visit today" for i in range(40)]
    lines += [f"We would like our dear guest {word(i)} all the best" for i in range(20)]
    lines += ["We would like " + " ".join(f"{word(i)}{'klmnopq'[k]}" for k in range(7)) for i in range(60)]
    rows = [(i, f"{line}\n{word(i)}x {word(i)}y") for i, line in enumerate(lines)]
    out = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, rows).withColumn("_rl_rk2", F.lit(1)).withColumn("_RL_DK", F.lit(1))).collect()}
    assert {i for i, r in out.items() if r.n_dropped} == {*range(1, 40), *range(41, 60)}
    assert out[1].text == "bx by" and not any(r.emptied for r in out.values())


def test_line_dedup_of_short_lines(spark, odd):
    rows = [(i, f"All rights reserved\nwort{'abc'[i]} drei\n日本{'語文字'[i]}") for i in range(3)] + [(3, "Read more\n 17 \n\n"), (4, "Read more\n 17 \n\n"), (5, "Read  more"), (6, "17"), (7, "18")]
    out = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert out[0].text == rows[0][1] and out[2].text == "wortc drei\n日本字"
    assert out[4].text == " 17 \n\n" and out[5].text == "" and out[6].text == "17" and out[7].text == "18"
    assert {i for i, r in out.items() if r.emptied} == {5}
    kept = {(r.doc_id, r.text) for r in line_dedup.line_dedup(odd).collect() if not r.emptied}
    assert kept == {r for r in odd_rows() if r[0] != 3}  # lines of variable fields alone stay


def brute_print(t, width=4):
    w = WORD.findall(lower(t))
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h)) if h else 0


def groups(n, edges):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprints_of_any_length():
    texts = [t for _, t in odd_rows()] + ["".join("ab cd\n"[i % 6] for i in range(n)) for n in range(0, 120, 7)] + ["w" * n + " v u t" for n in range(1, 90, 3)]
    assert [int(x) for x in simhash.fingerprints(pa.array(texts))] == [brute_print(t) for t in texts]


def test_fingerprints_of_very_many_shingles():
    h = np.random.default_rng(0).integers(0, 1 << 63, 150_000, dtype=np.int64).astype(np.uint64)
    at = np.array([0, 70_000, 70_000, 70_001, 150_000])
    want = [sum(1 << b for b in range(64) if 2 * int(((h[i:j] >> np.uint64(b)) & np.uint64(1)).sum()) > j - i) for i, j in zip(at, at[1:], strict=False)]
    assert [int(x) for x in simhash._majority(h, at)] == want


@pytest.mark.parametrize("n_groups", [7, 8, 9])
def test_pivot_links_equal_all_pairs(n_groups):
    rng = np.random.default_rng(3)
    f = set()
    for base in rng.integers(0, 1 << 62, 8):
        for _ in range(40):
            x = int(base)
            for b in rng.integers(0, 64, rng.integers(0, 8)):
                x ^= 1 << int(b)
            f.add(x)
    f = np.array(sorted(f), np.uint64)
    table = simhash.PivotTable(n_groups)
    keys = np.array([(int(k), int(v)) for b in simhash._keys(iter([pa.RecordBatch.from_arrays([pa.array(f.view(np.int64))], ["f"])]), 4, n_groups) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    batches = [pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["key", "f"]) for p in np.array_split(keys, 50)]
    number = {int(v): i for i, v in enumerate(f.view(np.int64))}
    edges = [(number[u], number[v]) for b in simhash._run_batches(iter(batches), 4, n_groups) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    true = [(i, j) for i in range(len(f)) for j in range(i) if bin(int(f[i] ^ f[j])).count("1") <= 4]
    assert groups(len(f), edges) == groups(len(f), true) and table.coordinates(f).shape == (len(f), simhash.FULL)


def test_groups_grow_with_the_number_of_fingerprints():
    assert [simhash.groups_for(n) for n in (10, 1 << 25, 1 << 31)] == [7, 8, 9]


def test_hot_simhash_keys_are_cut(spark, monkeypatch):
    """Many fingerprints on one key: as many components as by all pairs."""
    monkeypatch.setattr(simhash, "RUN_ROWS", 20)
    monkeypatch.setattr(simhash, "SAMPLE", 2)
    rng = np.random.default_rng(9)
    f = np.unique((rng.integers(0, 1 << 24, 300) & rng.integers(0, 1 << 24, 300)).astype(np.uint64) << np.uint64(40))
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "f long").repartition(3)
    number = {int(x): i for i, x in enumerate(f.view(np.int64))}
    edges = [(number[r.u], number[r.v]) for r in simhash.link_fingerprints(df).collect()]
    true = [(i, j) for i in range(len(f)) for j in range(i) if bin(int(f[i] ^ f[j])).count("1") <= 4]
    assert groups(len(f), edges) == groups(len(f), true)


def test_simhash_components(spark, odd, docs, empty):
    for df, rows in ((odd, odd_rows()), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        out = simhash.simhash_dedup(df.withColumn("component", F.lit("x")).withColumn("f", F.lit(0)), keep_text=False).collect()
        prints = [brute_print(t) for _, t in rows]
        part = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4])
        least = defaultdict(list)
        for (i, _), g in zip(rows, part, strict=True):
            least[g].append(i)
        best = {g: min((i for i in v if i is not None), default=None) for g, v in least.items()}
        want = sorted(repr((i, p, best[g])) for (i, _), p, g in zip(rows, prints, part, strict=True))
        assert sorted(repr((r.doc_id, r.fingerprint % (1 << 64), r.component_id)) for r in out) == want
    assert simhash.simhash_dedup(empty, keep_text=False).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(300, 299), (5, 5)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 200)}, 299: 299, 300: 299}
    assert components.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("run_rows,kind", [(8192, "double"), (30, "float")])
def test_embedding_dedup(spark, monkeypatch, run_rows, kind):
    monkeypatch.setattr(embedding_dedup, "RUN_ROWS", run_rows)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 24))
    x[100:140] = x[:40] + 0.15 * rng.standard_normal((40, 24))
    x[140:170] = x[0]
    x[170:200] = x[0] + 0.05 * rng.standard_normal((30, 24))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (401, []), (402, [0.0] * 24), (403, [float("nan")] * 24), (404, [None] + [1.0] * 23), (405, rows[5][1][:20]), (406, [2 * v for v in rows[5][1]]), (407, [float("inf")] * 24), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    df = df.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    u = np.array([r[1] for r in rows[:300]] + [rows[306][1], rows[308][1]])
    ids = [*range(300), 406, 5]
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    part = groups(len(ids), zip(*np.nonzero(near), strict=True))
    least = {}
    for i, g in zip(ids, part, strict=True):
        least[g] = min(least.get(g, i), i)
    out = embedding_dedup.embedding_dedup(df).collect()
    assert len(out) == len(rows)
    want = sorted([(i, int(near[k].sum()), least[part[k]]) for k, i in enumerate(ids)] + [(i, 0, i) for i in (400, 401, 402, 403, 404, 405, 407)])
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in out)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.99 * len(want)  # recall of the index
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))  # nothing below the threshold
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, signs, factor, error, rounding = embedding_dedup.decode(*embedding_dedup.encode(x), 3.0)
    est, true = (q @ signs.T) / factor, x @ x.T
    off = ~np.eye(400, dtype=bool)
    assert abs((est - true)[off].mean()) < 0.005 and rounding.max() < 0.02
    bound = error[None, :] + rounding[:, None] / factor[None, :]
    assert (np.abs(est - true) <= bound)[off].mean() > 0.99


@pytest.mark.parametrize("blocks", [1, 2])
def test_runs_link_as_brute_force(monkeypatch, blocks):
    """Long and short runs by both paths: what is asked holds all links."""
    monkeypatch.setattr(embedding_dedup, "_BLOCK", 1024 // blocks // 16)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((30, 32))[rng.integers(0, 30, 200)] + 0.25 * rng.standard_normal((200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side, near = np.arange(200) % 2, x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    for mask, s in ((near, None), (near & (side[:, None] != side[None, :]), side)):
        asks = embedding_dedup._ask_run(*embedding_dedup.encode(x), 0.9, 4.0, s)
        assert not (mask.any(1) & ~asks).any()
        links, label = embedding_dedup.link_run(x, np.ones(200, np.int64), np.zeros((200, 3), np.int32) + np.arange(200)[:, None], 2, 0.9, s)
        assert (links == mask.sum(1)).all() and label.tolist() == groups(200, zip(*np.nonzero(mask), strict=True))
    y = rng.standard_normal((300, 64))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert embedding_dedup._ask_run(*embedding_dedup.encode(y), 0.95, 4.0, None).sum() < 60  # of 300: codes alone discard the unrelated
    cut, t = np.arange(0, 201, 20), np.zeros(200, np.int64)
    mask = near & (np.arange(200)[:, None] // 20 == np.arange(200)[None, :] // 20)
    links, label = embedding_dedup.link_small_runs(x, np.ones(200, np.int64), np.zeros((200, 3), np.int32), cut, t, side, np.zeros(200, bool), 0.9)
    asks = embedding_dedup._ask_small_runs(*embedding_dedup.encode(x), cut, side, np.zeros(200, bool), 0.9, 4.0)
    assert (links == mask.sum(1)).all() and label.tolist() == groups(200, zip(*np.nonzero(mask), strict=True)) and not (mask.any(1) & ~asks).any()


def brute_set(t, width=5):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1))))


@pytest.mark.parametrize("window,run_rows", [(64, 16_384), (3, 40)])
def test_near_dedup_catches_similarity_of_four_fifths(spark, odd, empty, monkeypatch, window, run_rows):
    """Scattered edits: nearly all pairs of 0.8 and more are linked, and nothing below."""
    import corpus_pipeline

    monkeypatch.setattr(simhash_near, "WINDOW", window)
    monkeypatch.setattr(simhash_near, "RUN_ROWS", run_rows)
    monkeypatch.setattr(simhash_near, "SAMPLE", 2)

    rng = np.random.default_rng(5)
    rows = []
    for words, edits in ((100, 1), (100, 2), (200, 2), (200, 4), (200, 9), (1000, 20), (30, 1)):
        for _ in range(25):
            w = [f"w{x}" for x in rng.integers(0, 5000, words)]
            rows.append((len(rows), " ".join(w)))
            for p in rng.choice(words, edits, replace=False):
                w[p] = f"e{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(f"c{j}" if j != 4 * i else "x" for j in range(200))) for i in range(40)]  # a run of mutual copies
    sets = [brute_set(t) for _, t in rows]
    true = [(i, j) for i in range(len(rows)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    want = {rows[g][0] for g in groups(len(rows), true)}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    assert want <= kept and len(kept - want) <= 0.01 * (len(rows) - len(want)) and len(want) < 0.8 * len(rows)
    left = corpus_pipeline.near_dedup(spark, odd, "").collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(["1", "4", "7", "9", "10", "None"])
    assert corpus_pipeline.near_dedup(spark, empty, "").count() == 0


def test_near_tables_are_the_same_at_every_size(spark, monkeypatch):
    seen, keyed = [], simhash_near._keyed
    monkeypatch.setattr(simhash_near, "THREE_FROM", 1, raising=False)  # a table of a few rows is large
    monkeypatch.setattr(simhash_near, "_keyed", lambda *a: seen.append(keyed(*a)) or seen[-1])
    docs = frame(spark, [(1, "a b c d e f g"), (2, "h i j k l m n")])
    simhash_near.near_groups(docs.select("doc_id", "text", F.xxhash64("text").alias("h")))
    assert {r["count"] for r in seen[-1].groupBy("node").count().collect()} == {64}
    assert simhash_near.tables().shape == (64, 2)


def test_set_links_are_a_spanning_forest():
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.choice(40, 30)) if i % 3 else np.unique(rng.integers(0, 1000, 20)) for i in range(120)]
    near = np.array([[9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)) for b in sets] for a in sets])
    sizes, flat, label = np.array([len(x) for x in sets]), np.concatenate(sets), np.arange(120) // 2
    block = np.arange(120) % 2
    for b, mask in ((None, near), (block, near & (block[:, None] != block[None, :]))):
        start = [(i, j) for i in range(120) for j in range(i) if label[i] == label[j]]
        got = simhash_near.set_links(sizes, flat, label, b)
        assert all(mask[v, u] for v, u in got) and len(got) < 120
        assert groups(120, start + got) == groups(120, start + list(zip(*np.nonzero(mask), strict=True)))
