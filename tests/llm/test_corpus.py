import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import langid, license_scan, lm_scoring, mixing, packing, sharding
from ridgeline.llm.common import remainder

from llm_helpers import WORD, crc, frame, lower, odd_rows


def tokens(t):
    return [*WORD.findall(lower(t)), "\n"]


def brute_lm(rows, order=2):
    """Scores of all rows by the model of those whose remainder is not 2."""
    c1, by = Counter(), {order: Counter()}
    for i, t in rows:
        if crc(i, 7) != 2:
            s = ["\t"] * (order - 1) + tokens(t)
            for k in range(order - 1, len(s)):
                c1[s[k]] += 1
                by[order][tuple(s[k - order + 1 : k + 1])] += 1
    for k in range(order - 1, 0, -1):
        by[k] = Counter(g[1:] for g in by[k + 1])
    after = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in range(1, order + 1)}
    for k, counts in by.items():
        for g, c in counts.items():
            after[k][g[:-1]][0] += c
            after[k][g[:-1]][min(c, 3)] += 1
    d = {k: lm_scoring.discounts([sum(c == x for c in by[k].values()) for x in (1, 2, 3, 4)]) for k in by}
    n, v = sum(c1.values()), len(c1)

    def p(g):
        if not g:
            return 1 / (v + 1)
        total, *ns = after[len(g)][g[:-1]]
        if not total:
            return p(g[1:])
        c, k = by[len(g)][g], len(g)
        return (c - (d[k][min(c, 3) - 1] if c else 0)) / total + sum(x * y for x, y in zip(d[k], ns, strict=True)) / total * p(g[1:])

    out = []
    for i, t in rows:
        s = ["\t"] * (order - 1) + tokens(t)
        score = sum(math.log10(p(tuple(s[k - order + 1 : k + 1]))) for k in range(order - 1, len(s)))
        s = s[order - 1 :]
        out.append((i, len(s), sum(c1[w] > 0 for w in s), n, sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in s), score))
    return out


@pytest.mark.parametrize("hot,order,flush", [(0.004, 2, 5000), (0.0, 3, 5000), (0.01, 4, 3_000_000)])
def test_lm_scores(spark, docs, odd, empty, monkeypatch, hot, order, flush):
    monkeypatch.setattr(lm_scoring, "HOT_SHARE", hot)
    monkeypatch.setattr(lm_scoring, "SAMPLE_DOCS", 60)
    monkeypatch.setattr(lm_scoring, "CELL_TOKENS", 1000)
    monkeypatch.setattr(lm_scoring, "FLUSH", flush)
    for df, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, odd_rows())):
        model = lm_scoring.fit(df.filter(remainder(F.col("doc_id"), 7) != 2), order=order)
        out = lm_scoring.score_texts(df.withColumn("SCORE", F.lit("x")), model).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out), key=key)
        for a, b in zip(got, sorted(brute_lm(rows, order), key=key), strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
    nothing = lm_scoring.fit(empty, order=order)
    assert {r.score for r in lm_scoring.score_texts(odd, nothing).collect()} == {0.0}
    assert lm_scoring.score_texts(empty, nothing).count() == 0


def test_lm_counts_beyond_32_bits(tmp_path):
    path = f"file://{tmp_path}/x/1"
    lm_scoring._save(path, [np.array([1, 2], np.uint64), lm_scoring._narrow(np.array([3, 1 << 40])), lm_scoring._narrow(np.array([1, 2]))])
    keys, a, b = lm_scoring._map(path)
    assert keys.tolist() == [1, 2] and a.tolist() == [3, 1 << 40] and b.tolist() == [1, 2] and (a.itemsize, b.itemsize) == (8, 4)


def test_lm_beats_the_base_on_held_out_text(spark, docs):
    held = remainder(F.col("doc_id"), 7) == 2
    model = lm_scoring.fit(docs.filter(~held))
    s = lm_scoring.score_texts(docs.filter(held), model).agg(F.sum("base_score"), F.sum("score")).first()
    assert s[1] > s[0]


def test_sharding(spark, odd, empty):
    rows = odd.select("doc_id", "lang", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("key"))
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("lang"), (F.col("id") % 50 + 1).alias("size"), F.col("id").cast("string").alias("key"))
    for df in (rows, many):
        out = sharding.assign_shards(df.withColumn("slot", F.lit("clash")), "key", "size", 8).collect()
        assert len(out) == df.count()
        by = defaultdict(list)
        for r in out:
            by[r.shard].append(r)
        for v in by.values():
            assert sorted(r.slot for r in v) == list(range(len(v)))
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert len(by) == 8 and max(sizes) - min(sizes) <= 0.01 * sum(sizes)
    assert sharding.assign_shards(rows.limit(0), "key", "size", 8).count() == 0


def test_slot_map_versions(spark):
    m = sharding.SlotMap(spark, 64)
    weights = {i: (i * 37) % 100 + 1 for i in range(60)}
    old = {r.slot: r.shard for r in m.build(weights, 4).collect()}
    new = {r.slot: r.shard for r in m.add_shard(weights).collect()}
    moved = [s for s in old if old[s] != new[s]]
    assert moved and all(new[s] == 4 for s in moved) and m.version == 2
    loads = Counter()
    for s, k in new.items():
        loads[k] += weights.get(s, 0)
    share = sum(weights.values()) / 5
    assert abs(loads[4] - share) <= 0.2 * share
    assert {r.slot: r.shard for r in m.load(1).collect()} == old


def test_mixing(spark, docs, odd, empty):
    out = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.copy) for r in out) == sorted((r.doc_id, r.copy) for r in again)
    assert [r.shuffle_key for r in out] == sorted(r.shuffle_key for r in out)
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add((r.copy, r.n_copies))
    assert all({c for c, _ in v} == set(range(1, next(iter(v))[1] + 1)) for v in by.values())
    rows = [(i, "xxxx", "big" if i % 10 else "small") for i in range(4000)] + [(9001, None, None)]
    mixed = Counter(r.source for r in mixing.mix_sources(frame(spark, rows).withColumn("copy", F.lit(0)), {"big": 1.0, "small": 1.0}, mass="rows").collect())
    assert mixed[None] == 0 and abs(mixed["small"] - 2000) < 200 and abs(mixed["big"] - 2000) < 200
    huge = mixing.mix_sources(frame(spark, [(1, "a", "s")]), total=1000.0, mass="rows").count()
    assert 850 < huge < 1150
    nameless = mixing.mix_sources(frame(spark, [(i if i < 2000 else None, f"text {i}") for i in range(4000)]), mass="rows")
    kept = nameless.filter("copy = 1").groupBy(F.col("doc_id").isNull().alias("n")).count().collect()
    assert len(kept) == 2 and all(1150 < r["count"] < 1380 for r in kept)  # 2000 (1 - 1 / e)
    assert mixing.mix_sources(odd).count() > 0 and mixing.mix_sources(empty).count() == 0


def test_mixing_draws_poisson(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("text"))
    counts = Counter(r.n_copies for r in mixing.mix_sources(rows, total=30_000.0, mass="rows").select("doc_id", "n_copies").distinct().collect())
    counts[0] = 20_000 - sum(counts.values())
    for k in range(5):
        want = 20_000 * math.exp(-1.5) * 1.5**k / math.factorial(k)
        assert abs(counts[k] - want) < 5 * math.sqrt(want)


def test_packing(spark, docs, odd, empty):
    for df, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, odd_rows())):
        out = packing.best_fit_pack(df.withColumn("bin_id", F.lit("x")).withColumn("row", F.lit(0)).withColumn("_tokens", F.lit(0)).withColumn("_RL_Source", F.lit(0)), 512, bucket_tokens=20_000).collect()
        spans = defaultdict(list)
        for r in out:
            spans[r.doc_id].append((r.start_token, r.n_tokens))
        total = defaultdict(int)
        for i, t in rows:
            total[i] += len(tokens(t))
        assert {i: sum(n for _, n in v) for i, v in spans.items()} == dict(total)
        bins = defaultdict(list)
        for r in out:
            bins[r.bin_id].append(r)
        for v in bins.values():
            assert sum(r.n_tokens for r in v) <= 512
            at = 0
            for r in sorted(v, key=lambda r: r.bin_offset):
                assert r.bin_offset == at
                at += r.n_tokens
            assert max(Counter(r.source for r in v).values()) <= 2
            part = [r for r in v if r.n_tokens < 512]
            texts = Counter(dict_text(rows, r.doc_id) for r in part)
            assert max(texts.values(), default=0) <= 1
    assert packing.best_fit_pack(empty).count() == 0


def dict_text(rows, i):
    import re

    return re.sub(r"[\x20\x09-\x0D]", "", next((t for j, t in rows if j == i), None) or "")


def test_packing_is_best_fit():
    """Against a plain search for the tightest compatible bin."""
    rng = np.random.default_rng(4)
    sizes, sources, clusters = rng.integers(1, 100, 300), rng.integers(0, 4, 300), rng.integers(0, 250, 300)
    i, _, _, n, b, _ = packing.pack(sizes, sources, clusters, 100, 2)
    bins, want = [], {}
    for k in np.argsort(-sizes, kind="stable"):
        fits = [(100 - sum(sizes[m] for m in v), x) for x, v in enumerate(bins) if sum(sizes[m] for m in v) + sizes[k] <= 100 and sum(sources[m] == sources[k] for m in v) < 2 and all(clusters[m] != clusters[k] for m in v)]
        if fits:
            want[k] = min(fits)[0]
            best = [x for r, x in fits if r == min(fits)[0]]
            x = int(b[list(i).index(k)])
            assert x in best
            bins[x].append(k)
        else:
            x = int(b[list(i).index(k)])
            assert x == len(bins)
            bins.append([k])
    assert n.sum() == sizes.sum()


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_license_scan(spark, docs, odd, empty):
    import re

    extra = [
        (50, "Released under the MIT License. The MIT-license!  mit_license"),
        (51, "GNU General\nPublic  License, then general public license"),
        (52, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        (53, "Licensed under CC BY-NC 4.0."),
        (54, "license mit apache public general license license mitt licenseé"),
        (55, "permission is a word and so are granted and software, copy and use"),
    ]
    rows = odd_rows() + extra + [(r.doc_id + 1000, r.text) for r in docs.collect()]
    out = license_scan.scan_licenses(frame(spark, rows).withColumn("labels", F.lit(1)).withColumn("Score", F.lit(1)), keep_text=False).collect()
    want = []
    for i, t in rows:
        w = re.findall(ALNUM, lower(t))
        at, labels = [], set()
        for p, label in license_scan.BASE.items():
            k = p.split()
            here = [s for s in range(len(w)) if w[s : s + len(k)] == k]
            at += here
            labels |= {label} if here else set()
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[50].labels == "mit" and by[50].score == 1.0 and by[50].n_base == 3
    assert by[51].labels == "gpl" and by[52].labels == "bsd" and by[53].labels == "cc-by-nc" and by[55].labels == ""
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)
    assert license_scan.scan_licenses(empty).count() == 0


def brute_license(index, w):
    """Labels and score of a word list by all alignments of all templates."""
    text = f" {' '.join(w)} "
    out, best = {label for p, label in license_scan.BASE.items() if f" {p} " in text}, 0.0
    score = 0.5 if out else 0.0
    for t, words in enumerate(index.words):
        if not any(f" {' '.join(q)} " in text for q in index.phrases[t]):
            continue
        for at in range(-len(words), len(w)):
            share = sum(0 <= at + p < len(w) and w[at + p] == x for p, x in enumerate(words)) / len(words)
            if share >= license_scan.COVERAGE:
                near = " ".join(w[max(at - license_scan.SLACK, 0) : at + 2 * len(words) + license_scan.SLACK])
                if any(" ".join(q) in near for q in index.phrases[t]):
                    out.add(index.labels[t])
                    best = max(best, share)
    return ",".join(sorted(out)), max(score, best)


def test_license_labels_equal_all_alignments():
    """Long texts with several licences: as many labels as a brute-force alignment finds."""
    import pyarrow as pa

    index, rng = license_scan.TemplateIndex(), np.random.default_rng(4)
    filler = [*index.vocabulary, *(f"z{i}" for i in range(100))]
    texts = []
    for _ in range(12):
        words = [filler[i] for i in rng.integers(0, len(filler), 400)]
        for t in rng.choice(len(index.words), 5, replace=False):
            part = list(index.words[t])
            for p in rng.choice(len(part), int(0.3 * len(part) * rng.random()), replace=False):
                part[p] = "zz"
            at = int(rng.integers(0, len(words)))
            words[at:at] = part
        texts.append(" ".join(words))

    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert license_scan._scan_batch(batch, "text", index)[5].to_pylist() == [brute_license(index, t.split())[0] for t in texts]


def test_language_id(spark, docs, odd, empty):
    held = remainder(F.col("doc_id"), 5) == 0
    model = langid.fit(docs.filter(~held))
    out = langid.identify(docs.withColumn("Score", F.lit("x")).withColumn("LANG_PRED", F.lit(1)), model)
    got = out.filter(held & (F.col("lang_pred") != "und")).select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"))
    assert got.agg(F.avg("ok")).first()[0] > 0.97
    by = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert {i for i, r in by.items() if r.lang_pred == "und"} == {4, 5, 6, 11} and all(0 <= r.score <= 1 for r in by.values())
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def brute_langid(train, texts, buckets=langid.BUCKETS):
    """(language, posterior) of texts by plain counts of n-grams of the (text, lang) rows."""
    from ridgeline.llm.textkernel import mix

    def grams(text):
        seq = [0]
        for c in text or "":
            x = ord(c.lower()[0]) if c.isalpha() else 0
            if x or seq[-1]:
                seq.append(x)
        seq.append(0)
        out = []
        for n in langid.ORDERS:
            for i in range(len(seq) - n + 1):
                h = 0
                for x in seq[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + x) % (1 << 64)
                out.append((h + n) % (1 << 64))
        return (mix(np.array(out, np.uint64)) % np.uint64(buckets)).astype(np.int64) if any(seq) else None

    counts, n = {}, Counter()
    for t, lang in train:
        if lang is not None:
            n[lang] += 1
            mine = counts.setdefault(lang, np.zeros(buckets))
            if grams(t) is not None:
                mine += np.bincount(grams(t), minlength=buckets)
            else:  # a blank text is blanks alone
                mine += np.bincount((mix(np.array([1, 1, 2], np.uint64)) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    langs = sorted(counts)
    logp = np.array([np.log(counts[k] + langid.ALPHA) - np.log(counts[k].sum() + langid.ALPHA * buckets) for k in langs])
    out = []
    for t in texts:
        g = grams(t)
        if g is None or not langs:
            out.append(("und", 0.0))
            continue
        s = np.array([math.log(n[k] / sum(n.values())) + logp[j][g].sum() for j, k in enumerate(langs)])
        out.append((langs[int(s.argmax())], float(1 / np.exp(s - s.max()).sum())))
    return out


def test_language_id_matches_brute_force(spark):
    rows = [(1, "aa bb Ab", "x"), (2, "ccc, dd", "y"), (3, "b\n\tÉé", "x"), (4, "zz", None), (5, " 12 ", "y"), (6, None, "y"), (7, "日本", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, langid.fit(df)).collect()}
    want = brute_langid([(t, k) for _, t, k in rows], [t for _, t, _ in rows])
    for (i, _, _), w in zip(rows, want, strict=True):
        assert got[i][0] == w[0] and got[i][1] == pytest.approx(w[1], rel=1e-6)


def test_language_id_matches_plain_counts(spark):
    rows = [(1, "aa bb Ab", "x"), (2, "ccc dd", "y"), (3, "b", "x"), (4, "zz", None)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, priors, matrix = langid.fit(train, buckets=4096)
    counts = np.exp(matrix)
    assert langs == ["x", "y"] and np.allclose(np.exp(priors), [2 / 3, 1 / 3]) and np.allclose(counts.sum(1), 1)
    grams = lambda t: sum(max(len(f" {t} ") - n + (1 if n == 1 else 1), 0) for n in (2, 3))
    assert grams("b") == 3
    out = langid.identify(train, (langs, priors, matrix)).collect()
    assert {r.doc_id: r.lang_pred for r in out}[2] == "y"


def replay_packing(rows, out, capacity=packing.CAPACITY, most=packing.MAX_PER_SOURCE):
    """Whether each piece, longest first, went to a tightest compatible bin.  rows:
    (source, text) in the order of row numbers; out: (tokens, start, bin) by row."""
    import re

    rest = [len(tokens(t)) % capacity for _, t in rows]
    bins = {}
    for i in sorted((i for i in range(len(rows)) if rest[i]), key=lambda i: -rest[i]):
        source, text = rows[i][0], re.sub(r"[\x20\x09-\x0D]", "", rows[i][1] or "")
        (b,) = [b for n, at, b in out[i] if at == len(tokens(rows[i][1])) // capacity * capacity]
        fits = [left for left, sources, texts in bins.values() if left >= rest[i] and sources[source] < most and text not in texts]
        assert (b in bins) == bool(fits)
        left, sources, texts = bins.setdefault(b, (capacity, Counter(), set()))
        assert not fits or (left == min(fits) and sources[source] < most and text not in texts)
        sources[source] += 1
        texts.add(text)
        bins[b] = (left - rest[i], sources, texts)
    for (_, t), pieces in zip(rows, out, strict=True):
        assert sum(n for n, _, _ in pieces) == len(tokens(t))


def brute_near(rows):
    """Ids of rows (id, text) that stay of their groups of similarity 4/5."""
    from test_dedup import brute_set, groups

    sets = [brute_set(t) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or [None]:
            by[x].append(i)
    pairs = {(i, j) for v in by.values() for i in v for j in v if i < j}
    link = [(i, j) for i, j in pairs if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    part = groups(len(rows), link)
    least = {}
    for (i, _), g in zip(rows, part, strict=True):
        least[g] = min(least.get(g, i), i)
    return set(least.values())


def test_pipeline_equals_brute_force(spark, data, docs):
    """The whole pipeline against plain Python and SQL, stage by stage."""
    import corpus_pipeline as cp
    import duckdb
    import pandas as pd

    from ridgeline.llm import line_dedup

    d = docs.toPandas()
    train = [(t, k) for i, t, k in zip(d.doc_id, d.text, d.lang, strict=True) if crc(i, 5)]
    pred = brute_langid(train, d.text)
    d = d[[lang != "und" and score >= cp.LEAST_SCORE for lang, score in pred]]
    db = duckdb.connect()
    db.register("documents", d)
    lines = db.sql(line_dedup.OP3_SQL).df()
    d = d.drop(columns=["text", "n_chars"]).merge(lines[~lines.emptied][["doc_id", "text"]], on="doc_id")
    d = d[d.doc_id.isin(brute_near(list(zip(d.doc_id, d.text, strict=True))))]
    db = duckdb.connect()
    db.register("documents", d)
    mixed = db.sql(mixing.OP5_SQL).df().sort_values("shuffle_key")
    want = Counter()
    for i, t in zip(mixed.doc_id, mixed.text, strict=True):
        n = len(tokens(t))
        want.update((i, k, min(packing.CAPACITY, n - k * packing.CAPACITY)) for k in range(-(-n // packing.CAPACITY)))
    out = cp.run(spark, data)
    got = out.collect()
    assert Counter((r.doc_id, r.chunk, r.n_tokens) for r in got) == want
    assert {(r.doc_id, r.source, r.n_chars) for r in got} == {(i, s, len(t)) for i, s, t in zip(mixed.doc_id, mixed.source, mixed.text, strict=True)}
    fill, sources = Counter(), defaultdict(Counter)
    for r in got:
        fill[r.bin_id] += r.n_tokens
        sources[r.bin_id][r.source] += 1
    assert max(fill.values()) <= packing.CAPACITY and max(max(v.values()) for v in sources.values()) <= packing.MAX_PER_SOURCE
    assert isinstance(mixed, pd.DataFrame)


def test_stages_of_odd_and_empty_tables(spark, data, docs, odd, empty):
    """Null, empty, long, tied and repeated rows, clashing columns, and no rows at all."""
    import corpus_pipeline as cp

    clash = odd.withColumn("Score", F.lit("x")).withColumn("EMPTIED", F.lit(1)).withColumn("d", F.lit(2)).withColumn("h2", F.lit(3)).withColumn("copy", F.lit(4)).withColumn("Node", F.lit(5))
    clash = clash.unionByName(docs.filter("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 1000).select(*docs.columns, *[F.lit(None).alias(c) for c in clash.columns[5:]]))
    stages = dict(cp.STAGES)
    for name, f in cp.STAGES[:-1]:
        out = f(spark, clash, data)
        assert out.columns == clash.columns and out.dtypes == clash.dtypes, name
        rows = out.collect()
        assert all(r.Score == "x" and r.h2 == 3 for r in rows if (r.doc_id or 0) < 1000)
        none = f(spark, empty, data)
        assert none.columns == empty.columns and none.count() == 0, name
    assert stages["packing"](spark, clash, data).select("doc_id").distinct().count() == clash.select("doc_id").distinct().count()
    assert stages["packing"](spark, empty, data).count() == 0


def test_pipeline_stages(spark, data, docs):
    import corpus_pipeline as cp

    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    stage, kept = docs, docs.count()
    for _, f in cp.STAGES[:-1]:
        out = f(spark, stage, data)
        assert out.columns == docs.columns
        stage = spark.createDataFrame(out.collect(), docs.schema)
        if f is not cp.mix:
            assert 0.5 * kept < stage.count() <= kept
            kept = stage.count()
    packed = cp.STAGES[-1][1](spark, stage, data)
    assert packed.select("doc_id").distinct().count() == stage.select("doc_id").distinct().count()
    bad = frame(spark, [(1, None), (2, ""), (3, "1234 !!"), (4, "The house is on the hill and it is red"), (4, "The house is on the hill and it is red"), (5, "The house is on the hill and it is red")])
    assert {r.doc_id for r in cp.language_id(spark, docs.unionByName(bad.withColumn("doc_id", F.col("doc_id") + 10**6)), data).filter("doc_id > 1000000").collect()} == {1000004, 1000005}
    assert [r.doc_id for r in cp.near_dedup(spark, bad.filter("doc_id > 3"), data).collect()] == [4]
