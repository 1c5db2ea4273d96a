"""Exact and inverted-file search, codecs, graphs against NumPy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import kernels, vector as V
from ridgeline.operators import binary, cluster, codecs, evaluate, graph, ivf, knn, maintain, ordering, refine, spec, transforms


def frame(spark, x, name="id", first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, vec array<float>")


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(1)
    b = rng.standard_normal((400, 16)).astype(np.float32)
    q = rng.standard_normal((12, 16)).astype(np.float32)
    return frame(spark, b).persist(), frame(spark, q, "qid").persist(), b.astype(float), q.astype(float)


def ids_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.id)
    return out


def brute(q, b, k, metric="l2", p=None):
    d = kernels.pairwise(q, b, metric, p)
    s = -d if metric in V.LARGEST_FIRST else d
    return {i: np.lexsort((np.arange(len(b)), row))[:k].tolist() for i, row in enumerate(s)}


@pytest.mark.parametrize("metric,p", [("l2", None), ("ip", None), ("cosine", None), ("l1", None), ("linf", None), ("lp", 3.0), ("canberra", None), ("braycurtis", None)])
def test_knn_matches_brute_force(sets, metric, p):
    base, queries, b, q = sets
    assert ids_of(knn.knn(queries, base, 5, metric, p)) == brute(q, b, 5, metric, p)


def test_expressions_match_kernels(spark):
    rng = np.random.default_rng(2)
    x, y = rng.random((3, 8)), rng.random((3, 8))
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(3)], "i int, a array<double>, b array<double>")
    for m in V.METRICS:
        got = [r.d for r in df.select("i", V.distance(m, F.col("a"), F.col("b"), 3.0).alias("d")).orderBy("i").collect()]
        assert np.allclose(got, np.diag(kernels.pairwise(x, y, m, 3.0))), m


def test_knn_in_blocks_equals_broadcast(sets, monkeypatch):
    base, queries, b, q = sets
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 100)
    out = knn._compare  # blocks of 100 rows: 1 x 4 pairs of blocks
    assert out is not None
    assert ids_of(knn.knn(queries, base, 5)) == brute(q, b, 5)


def test_range_and_budget(sets):
    base, queries, b, q = sets
    d = kernels.pairwise(q, b)
    r = float(np.quantile(d, 0.02))
    pairs = knn.range_join(queries, base, r)
    assert {(x.qid, x.id) for x in pairs.collect()} == set(zip(*map(lambda v: v.tolist(), np.nonzero(d < r)), strict=True))
    cut = knn.range_budget(pairs, 20, 10)
    assert cut.count() == 10
    counts = {x.qid: (x.n, x.lims) for x in knn.range_counts(queries, pairs).collect()}
    assert [counts[i][0] for i in range(12)] == (d < r).sum(1).tolist()
    assert [counts[i][1] for i in range(12)] == np.cumsum((d < r).sum(1)).tolist()


def test_ties_nulls_and_padding(spark):
    base = spark.createDataFrame([(1, [0.0, 0.0]), (0, [0.0, 0.0]), (2, None), (3, [1.0, 1.0])], "id long, v array<float>")
    rows = knn.vectors(base, "id", "v")
    q = spark.createDataFrame([(7, [0.0, 0.0])], "qid long, vec array<float>")
    assert ids_of(knn.knn(q, rows, 2)) == {7: [0, 1]}
    padded = {r["rank"]: (r.id, r.distance) for r in knn.pad(knn.knn(q, rows, 5), q, 5).collect()}
    assert padded[4] == (-1, float("inf")) and padded[3] == (3, 2.0)
    assert knn.knn(q, rows.limit(0), 3).count() == 0


def test_graph_self_join_and_shards(sets):
    base, queries, b, q = sets
    d = kernels.pairwise(b, b)
    np.fill_diagonal(d, np.inf)
    assert ids_of(knn.knn_graph(base, 3)) == {i: np.argsort(r, kind="stable")[:3].tolist() for i, r in enumerate(d)}
    assert ids_of(knn.sharded_knn(queries, base, 3, 4)) == brute(q, b, 4)


def test_knn_1d_with_many_slices(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, q = rng.integers(0, 300, 500) / 3, rng.random(20) * 100
    base = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    asked = spark.createDataFrame([(i, float(v)) for i, v in enumerate(q)], "qid long, x double")
    monkeypatch.setattr(knn, "BLOCK_ROWS", 60)
    want = {i: np.lexsort((np.arange(500), np.abs(x - v)))[:4].tolist() for i, v in enumerate(q)}
    assert ids_of(knn.knn_1d(asked, base, 4)) == want


def test_global_rank_in_slices(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SLICE_ROWS", 50)
    df = spark.range(300).withColumn("x", (F.col("id") * 37) % 101)
    monkeypatch.setattr(ordering.slices, "__defaults__", (50,))
    got = [r.id for r in ordering.global_rank(df, "x", ties=["id"]).orderBy("place").collect()]
    assert got == sorted(range(300), key=lambda i: (i * 37 % 101, i))


def test_kmeans_improves_and_splits(sets):
    base, _, b, _ = sets
    km = cluster.kmeans(base, 8, niter=6)
    obj = [s["objective"] for s in km.stats]
    assert all(x >= y - 1e-6 for x, y in zip(obj, obj[1:], strict=False)) and km.centroids.shape == (8, 16)
    frozen = cluster.kmeans(base, 4, niter=3, init=b[:2], frozen=True)
    assert np.allclose(frozen.centroids[:2], b[:2])
    w = np.array([5.0, 0.0, 3.0])
    c = np.arange(6, dtype=float).reshape(3, 2)
    assert cluster.split_empty(c, w, np.random.default_rng(0)) == 1 and (w > 0).all()


def test_kmeans_1d_is_optimal():
    from itertools import combinations

    x = np.sort(np.random.default_rng(4).random(9))
    best = min(sum(((p - p.mean()) ** 2).sum() for p in np.split(x, cuts)) for cuts in combinations(range(1, 9), 2))
    c, cost = cluster.kmeans_1d(x, None, 3)
    assert len(c) == 3 and np.isclose(cost, best)
    again, same = cluster.kmeans_1d(np.concatenate((x, x[:4])), None, 3)
    by_weight, cost = cluster.kmeans_1d(x, np.where(np.arange(9) < 4, 2, 1), 3)
    assert np.allclose(again, by_weight) and np.isclose(same, cost)


def test_ivf_is_exact_on_all_lists_and_monotone(sets):
    base, queries, b, q = sets
    c = ivf.train(base, 8, niter=4)
    rows = ivf.add(base, c).persist()
    truth = knn.knn(queries, base, 5).persist()
    recall = [evaluate.intersection_at(ivf.search(queries, rows, ivf.probe(queries, c, n), 5, page_rows=30), truth, 5).first()[0] for n in (1, 3, 8)]
    assert recall == sorted(recall) and recall[-1] == 1.0
    probes = ivf.probe(queries, c, 8)
    sizes = {r.list_no: r["size"] for r in ivf.list_sizes(rows).collect()}
    kept = {}
    for r in ivf.cut_probes(probes, rows, 100).collect():
        kept.setdefault(r.qid, []).append((r.probe, r.list_no))
    for probed in kept.values():
        before = [sizes.get(n, 0) for _, n in sorted(probed)][:-1]
        assert sum(before) < 100
    assert np.isclose(ivf.imbalance_factor(rows, 8).first()[0], 8 * sum(v * v for v in sizes.values()) / 400**2)


def test_ivf_reads_probed_lists_only(sets, spark, tmp_path):
    """The plan of a search filters the folders of the postings; many queries, in blocks
    and pages, find the same."""
    base, queries, b, q = sets
    c = ivf.train(base, 8, niter=4)
    rows = ivf.store(ivf.add(base, c), f"file://{tmp_path}/lists")
    probes = ivf.probe(queries.filter("qid < 2"), c, 1).persist()
    lists = sorted({r.list_no for r in probes.collect()})
    found = ivf.search(queries.filter("qid < 2"), rows, probes, 3)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "Exchange hashpartitioning(list_no" not in plan and len(lists) < 8
    read = ivf._probed(rows, probes, lists).select("list_no").distinct().collect()
    assert sorted(r.list_no for r in read) == lists


@pytest.mark.parametrize("literal,page,few", [(2048, 30, 0), (0, 7, 0), (0, 7, 1 << 20)])
def test_ivf_of_many_queries(sets, monkeypatch, literal, page, few):
    base, queries, _, _ = sets
    c = ivf.train(base, 8, niter=4)
    rows = ivf.add(base, c).persist()
    probes = ivf.probe(queries, c, 3).persist()
    plain = sorted(map(tuple, ivf.search(queries, rows, probes, 5, with_list=True).collect()))
    within = sorted(map(tuple, ivf.search(queries, rows, probes, None, radius=20.0).collect()))
    monkeypatch.setattr(knn, "BROADCAST_BYTES", few)
    monkeypatch.setattr(ivf, "LITERAL_LISTS", literal)
    assert plain and within
    assert [r[:3] for r in plain] == [r[:3] for r in sorted(map(tuple, ivf.search(queries, rows, probes, 5, page_rows=page, with_list=True).collect()))]
    assert [r[:2] for r in within] == [r[:2] for r in sorted(map(tuple, ivf.search(queries, rows, probes, None, radius=20.0, page_rows=page).collect()))]


def test_kernels_with_holes_and_far_from_origin():
    rng = np.random.default_rng(8)
    d = rng.random((1, 12))
    d[0, [1, 2, 4, 5, 7, 8, 9]] = np.nan
    top = kernels.TopK(10, False)
    top.add(d, np.arange(12))
    assert sorted(top.result()[2].tolist()) == [0, 3, 6, 10, 11]
    x = 1e6 + 1e-3 * rng.random((5, 16))
    y = np.concatenate((x + 1e-3 * rng.random((5, 16)), -x, np.full((1, 16), np.nan)))
    want = ((x[:, None, :] - y[None, :, :]) ** 2).sum(2)
    assert np.allclose(kernels.pairwise(x, y), want, rtol=1e-6, equal_nan=True)
    t = rng.random((3, 4, 16))
    steps, scale, low = kernels.quantize_tables(t)
    codes = rng.integers(0, 16, (50, 4))
    off = np.abs(kernels.lookup_sum(steps.astype(np.int64), codes) * scale[:, None] + low[:, None] - kernels.lookup_sum(t, codes))
    assert steps.dtype == np.uint8 and (off <= 2 * scale[:, None] + 1e-12).all()


def test_range_forms_agree(sets):
    base, queries, b, q = sets
    d = kernels.pairwise(q, b)
    r = float(np.quantile(d, 0.05))
    want = set(zip(*map(lambda v: v.tolist(), np.nonzero(d < r)), strict=True))
    assert {(x.qid, x.id) for x in knn.range_by_topk(queries, base, r, 4).collect()} == want
    pairs, radius = knn.range_in_blocks(queries, base, r, 1 << 40, first=2)
    assert {(x.qid, x.id) for x in pairs.collect()} == want and radius == r
    pairs, radius = knn.range_in_blocks(queries, base, r, 50, first=2)
    assert radius < r and {(x.qid, x.id) for x in pairs.collect()} == set(zip(*map(lambda v: v.tolist(), np.nonzero(d < radius)), strict=True))


def test_indexes_grow_and_are_reset(sets):
    base, queries, b, q = sets
    half = base.filter("id < 200"), base.filter("id >= 200")
    truth = knn.knn(queries, base, 5).persist()
    for text in ("HNSW8", "NSG12,Flat", "IVF4,Flat", "IVF4,FlatDedup", "IVF4_HNSW4,Flat", "IVF4(IVF2,Flat),Flat"):
        index = spec.build(text, base, niter=3).add(half[0])
        both = index.add(half[1])
        assert evaluate.intersection_at(both.search(queries, 5, nprobe=4, ef=60), truth, 5).first()[0] > 0.9, text
        assert index.reset().add(half[1]).rows.count() == 200 and index.clone().rows.count() == 200
        assert both.remove(maintain.IdRange(0, 100)).rows.count() == 300
    r = float(np.quantile(kernels.pairwise(q, b), 0.05))
    assert spec.build("IVF4,Flat", base).add(base).range_search(queries, r, nprobe=4).count() == knn.range_join(queries, base, r).count()
    assert spec.build("SQ8", base).add(base).range_search(queries, r).count() > 0
    pq = spec.build("IVF4,PQ4x4", base).add(base)
    assert ids_of(pq.search(queries, 5, nprobe=4, ht=100)) == ids_of(pq.search(queries, 5, nprobe=4))
    with pytest.raises(spec.SpecError):
        spec.build("HNSW8", base).add(base).range_search(queries, r)
    with pytest.raises(spec.SpecError):
        spec.build("IMI2x12,Flat", base)
    with pytest.raises(spec.SpecError):
        spec.build("Flat", base).add(base).search(queries, 3, ht=4)


def test_two_level_codes(sets):
    base, _, b, _ = sets
    c = ivf.train(base, 300, niter=1)
    codec = codecs.CoarseCodec(c, codecs.ProductQuantizer.train(base, 4, 4, 6))
    codes = codec.encode_matrix(b)
    assert codec.prefix == 2 and (codec.unpack(codec.pack(codes)) == codes).all() and len(codec.pack(codes)[0]) == 6
    assert ((codec.decode_matrix(codes) - b) ** 2).mean() < (b**2).mean()
    km = cluster.kmeans_encoded(codec, codec.encode(base).select("id", "code"), 4, niter=3)
    assert km.centroids.shape == (4, 16)
    by = cluster.kmeans_by(base, 4, lambda df, c: cluster.assign_lists(df, c), niter=4)
    plain = cluster.kmeans(base, 4, niter=4)
    cost = lambda c: kernels.pairwise(b, c).min(1).sum()
    assert cost(by) < 1.1 * cost(plain.centroids)


def test_codecs_round_trip(sets):
    base, queries, b, _ = sets
    errors = []
    for kind in ("4bit", "6bit", "8bit", "fp16"):
        sq = codecs.ScalarQuantizer.train(base, kind)
        errors.append(float(((sq.decode_matrix(sq.encode_matrix(b)) - b) ** 2).mean()))
        if kind != "fp16":
            got = np.array([r.c for r in base.orderBy("id").select(sq.encode_column(F.col("vec")).alias("c")).collect()])
            assert (got == sq.encode_matrix(b)).all()
    assert errors == sorted(errors, reverse=True)
    pq, fine = (codecs.ProductQuantizer.train(base, m, 4, 8) for m in (2, 8))
    e = [float(((c.decode_matrix(c.encode_matrix(b)) - b) ** 2).mean()) for c in (pq, fine)]
    assert e[1] < e[0]
    x = b[:3]
    assert np.allclose(fine.distances(x, fine.encode_matrix(b), "l2"), kernels.pairwise(x, fine.decode_matrix(fine.encode_matrix(b))))
    rq = codecs.ResidualQuantizer.fit(b, 3, 4, beam=4, niter=6)
    one = codecs.ResidualQuantizer(rq.books, 1)
    err = lambda c: float(((c.decode_matrix(c.encode_matrix(b)) - b) ** 2).sum())
    assert err(rq) <= err(one)
    assert np.allclose(rq.distances(x, rq.encode_matrix(b), "l2"), kernels.pairwise(x, rq.decode_matrix(rq.encode_matrix(b))))
    lsq = codecs.LocalSearchQuantizer.fit(b, 3, 4, train_rounds=3)
    assert err(lsq) <= 1.05 * err(rq)
    lattice = codecs.LatticeCodec.train(base, 2, 14, 6)
    back = lattice.decode_matrix(lattice.encode_matrix(b))
    assert ((back - b) ** 2).sum() < 0.5 * (b**2).sum()
    codes = np.random.default_rng(0).integers(0, 32, (7, 5))
    assert (kernels.unpack_codes(kernels.pack_codes(codes, 5), 5, 5) == codes).all()
    found = fine.search(queries, fine.encode(base), 5)
    assert found.count() == 60


def test_polysemous_and_refine(sets):
    base, queries, b, q = sets
    pq = codecs.ProductQuantizer.train(base, 4, 4, 6).polysemous(300)
    coded = pq.encode(base).persist()
    whole = ids_of(pq.search(queries, coded, 5))
    assert ids_of(pq.search(queries, coded, 5, kind="polysemous", ht=100)) == whole
    fewer = pq.search(queries, coded, 400, kind="polysemous", ht=4).count()
    assert fewer < 12 * 400
    assert ids_of(refine.refine(pq.search(queries, coded, 400), queries, base, 5)) == brute(q, b, 5)
    with pytest.raises(ValueError):
        refine.refine(coded, queries, base, 5, "l1")


def test_transforms(sets):
    base, _, b, _ = sets
    p = transforms.pca(base, 16)
    y = p.apply_matrix(b)
    assert np.allclose(np.cov(y.T, bias=True), np.diag(np.diag(np.cov(y.T, bias=True))), atol=1e-8) and np.allclose(p.reverse_matrix(y), b)
    white = transforms.pca(base, 8, eigen_power=-0.5).apply_matrix(b)
    assert np.allclose(white.var(0), 1)
    rot = transforms.random_rotation(16, 16)
    assert rot.orthonormal and np.allclose(rot.reverse_matrix(rot.apply_matrix(b)), b)
    pad = transforms.Remap.pad(16, 20)
    assert np.allclose(pad.reverse_matrix(pad.apply_matrix(b)), b)
    err = lambda t: float(((lambda z, c: c.decode_matrix(c.encode_matrix(z)) - z)(t.apply_matrix(b), codecs.ProductQuantizer.fit(t.apply_matrix(b), 4, 4, 8)) ** 2).sum())
    assert err(transforms.opq(base, 4, bits=4, niter=4)) < 1.1 * err(transforms.Linear(np.eye(16)))
    x = transforms.itq(base, 8, niter=5).apply_matrix(b)
    assert x.shape == (400, 8)
    with pytest.raises(ValueError):
        transforms.Normalise(1.0)


def test_binary_hash_is_subset_and_exact_at_full_flips(spark):
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 6, 60)
    base = spark.createDataFrame([(i, [int(w)]) for i, w in enumerate(words)], "id long, code array<long>")
    queries = base.filter("id < 5").withColumnRenamed("id", "qid")
    n = [binary.hash_range(queries, base, 4, 6, f).count() for f in (0, 1, 6)]
    assert n == sorted(n) and n[-1] == binary.hamming_range(queries, base, 4).count()
    d = np.bitwise_count(words[:5, None] ^ words[None, :])
    assert n[-1] == int((d < 4).sum())
    assert ids_of(binary.hamming_knn(queries, base, 3)) == ids_of(binary.knn_by_real(queries, base, 3, 64))


def test_graph_indexes_reach_recall(sets):
    base, queries, _, _ = sets
    truth = knn.knn(queries, base, 5).persist()
    rows = graph.with_shards(base, 2).persist()
    for edges in (graph.hnsw_build(rows, 8), graph.nsg_build(rows, 12, 24)):
        found = graph.graph_search(queries, rows, edges.persist(), 5, 40)
        assert evaluate.intersection_at(found, truth, 5).first()[0] > 0.9
    exact = knn.knn_graph(base, 10)
    approx = graph.nn_descent(base, 10)
    assert evaluate.intersection_at(approx, exact, 10).first()[0] > 0.9


def test_nn_descent_recall_of_the_registered_query(spark):
    from ridgeline.plans import catalog

    data = "/root/testdata/sf0.1"
    found = catalog.queries()["nn_descent_graph"](spark, data)
    exact = knn.knn_graph(catalog._base(spark, data), 8)
    assert evaluate.intersection_at(found, exact, 8).first()[0] >= 0.9


def test_maintenance_algebra(sets):
    base, queries, _, _ = sets
    a, b = base.filter("id < 200"), base.filter("id >= 200")
    assert ids_of(knn.knn(queries, maintain.merge(a, b), 4)) == ids_of(knn.knn(queries, base, 4))
    assert maintain.remove_ids(base, maintain.IdRange(10, 20)).count() == 390
    assert maintain.keep_ids(base, maintain.IdArray((1, 2, 999))).count() == 2
    with pytest.raises(ValueError):
        maintain.merge(a, b, 0, ("Flat", "SQ8"))
    w = maintain.SlidingWindow()
    parts = [base.filter(F.col("id") % 4 == i) for i in range(4)]
    for i, p in enumerate(parts):
        w = w.step(p, i >= 2)
    assert {r.id for r in w.rows().collect()} == {i for i in range(400) if i % 4 in (2, 3)}
    c = ivf.train(base, 4, niter=2)
    rows = ivf.add(base, c)
    halves = [maintain.copy_subset(rows, "share", *r).select("id").collect() for r in ((0, 150), (150, 400))]
    assert sorted(r.id for h in halves for r in h) == list(range(400))


def test_evaluation_conventions(spark):
    none = spark.createDataFrame([], "qid long, id long, distance double")
    some = spark.createDataFrame([(1, 5, 0.1)], "qid long, id long, distance double")
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    pr = lambda r, t, m: tuple(evaluate.range_precision_recall(q, r, t, m).first())
    assert pr(none, none, "overall") == (1.0, 1.0) and pr(some, none, "overall") == (0.0, 0.0)
    assert pr(none, some, "overall") == (1.0, 0.0) and pr(some, some, "average") == (1.0, 1.0)
    pts = spark.createDataFrame([("a", 0.5, 1.0), ("b", 0.6, 1.0), ("c", 0.9, 3.0), ("d", 0.0, 0.1), ("e", 0.6, 2.0)], "key string, perf double, t double")
    assert {r.key for r in evaluate.pareto(pts).collect()} == {"b", "c"}
    assert evaluate.set_parameters({"ht": 1}, "nprobe=4,k_factor=2.5") == {"ht": 1, "nprobe": 4, "k_factor": 2.5}
    tried = evaluate.explore(lambda p: p["nprobe"], lambda n: n / 10, {"nprobe": [1, 2, 4]}, spark)
    assert tried.count() == 3


@pytest.mark.parametrize("text", ["Flat", "IVF16,Flat", "PCA32,IVF16,PQ8x4", "OPQ8_32,IVF16,PQ8,RFlat", "IMI2x4,PQ8", "HNSW16", "HNSW16,SQ8", "NSG12,Flat", "LSHrt", "IVF8(IVF4,Flat),SQ8", "IDMap,Flat", "Flat,IDMap", "IVF16_HNSW8,PQ4x4fs", "ZnLattice3x10_4", "RQ4x4_Nfloat", "LSQ4x4", "IVF16,ITQ32,SH-1.5g", "IVF16,PQ8+4", "SQ6,Refine(SQ8)"])
def test_specifications_parse(text):
    assert str(spec.parse(text)) == text


@pytest.mark.parametrize("text", ["", "IVF16", "Nope", "PCA32", "IVF16,Nope", "IVF(4,Flat"])
def test_bad_specifications_raise(text):
    with pytest.raises(spec.SpecError):
        spec.parse(text)


def test_built_indexes_answer(sets):
    base, queries, b, q = sets
    truth = knn.knn(queries, base, 5).persist()
    floors = {"Flat": 1.0, "IVF4,Flat": 1.0, "SQ8": 0.9, "IVF4,SQ8": 0.9, "PQ8x4,RFlat": 0.8, "IVF4,PQ8x4": 0.3, "HNSW8": 0.9, "IMI2x2,Flat": 0.99, "LSHr": 0.15, "IVF4,ITQ16,SH3c": 0.1, "IVF4,PQ4+4": 0.6, "HNSW8,SQ8": 0.85, "RQ3x4": 0.2}
    for text, least in floors.items():
        index = spec.build(text, base, niter=3).add(base)
        found = index.search(queries, 5, nprobe=16, k_factor=8.0, ef=40)
        assert evaluate.intersection_at(found, truth, 5).first()[0] >= least, text
    small = spec.build("SQ8", base).add(base)
    back = small.reconstruct([3]).first()
    assert np.abs(np.array(back.vec) - b[3]).max() < 0.05
    assert small.remove(maintain.IdRange(0, 100)).rows.count() == 300


def test_binary_specifications(spark):
    rng = np.random.default_rng(6)
    base = spark.createDataFrame([(i, [int(w)]) for i, w in enumerate(rng.integers(0, 1 << 62, 150))], "id long, code array<long>")
    queries = base.filter("id < 5").withColumnRenamed("id", "qid")
    truth = knn.rank_pairs(spec.build_binary("BFlat", base, 64).search(queries, 150).select("qid", "id", "distance"), 1, "l2")
    for text, args in (("BIVF4", {"nprobe": 4}), ("BHNSW8", {"ef": 60}), ("BHash8", {"nflip": 8}), ("BHash4x8", {"nflip": 2})):
        found = spec.build_binary(text, base, 64).search(queries, 1, **args)
        assert sorted((r.qid, r.id) for r in found.collect()) == sorted((r.qid, r.id) for r in truth.collect()), text
    with pytest.raises(spec.SpecError):
        spec.parse_binary("BNope")


def test_batch_planner():
    from itertools import product

    from ridgeline.operators import batch

    assert batch.order_pages([5, 1, 9, 3], [True, True, False, False]) == [1, 0, 2, 3]
    cost = batch.interpolated([(1, 1.0), (10, 2.0)])
    assert cost(1) == 1.0 and cost(20) == 4.0
    rows, work = [3, 1, 4, 1, 5], [2, 7, 1, 8, 2]

    def seconds(ends):
        cuts = [0, *ends]
        return batch.overlapped_time([(cost(sum(rows[a:b])), cost(sum(work[a:b]))) for a, b in zip(cuts, cuts[1:], strict=False)])

    best = min(seconds([i + 1 for i, c in enumerate(bits) if c] + [5]) for bits in product((0, 1), repeat=4))
    assert np.isclose(seconds(batch.group_pages(rows, work, cost, cost)), best)
    assert ivf.page_size([1000, 1000, 1000]) <= 1000


def test_product_codes_of_a_large_sample_take_bounded_memory():
    import tracemalloc

    x = np.random.default_rng(1).normal(size=(16384, 64))
    pq = codecs.ProductQuantizer(np.stack(np.split(x[:256], 16, axis=1)))
    want = pq.tables(x[:500]).argmin(2)
    tracemalloc.start()
    try:
        codes = pq.encode_matrix(x)
        codecs.lloyd(x[:, :4], 256, 1)
        assert tracemalloc.get_traced_memory()[1] < 300e6
    finally:
        tracemalloc.stop()
    assert (codes[:500] == want).all()
