"""The registered queries: against their SQL, or against brute force where SQL cannot."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from llm_helpers import crc, lower
from pyspark.sql import functions as F
from test_corpus import ALNUM, brute_langid, brute_license, brute_lm, replay_packing, tokens
from test_dedup import brute_print, groups

from ridgeline.llm import registry

Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = Q[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == cols
    assert got == sorted(repr(tuple(r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())


def test_op1(spark, data, rows):
    out = sorted(Q["op1_lm_scoring"](spark, data).collect(), key=lambda r: r.doc_id)
    for r, want in zip(out, brute_lm(rows), strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == want[:4] and r.held_out == (crc(r.doc_id, 7) == 2)
        assert r.base_score == pytest.approx(want[4], rel=1e-9) and r.score == pytest.approx(want[5], rel=1e-9)


def test_op2_crc(spark, data, rows):
    by = {r.doc_id: r for r in Q["op2_sharding"](spark, data).collect()}
    assert all((by[i].text_crc32, by[i]["size"]) == (zlib.crc32(t.encode()), len(t.encode()) + 1) for i, t in rows)


def test_op4(spark, data, docs):
    out = Q["op4_langid"](spark, data)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == docs.count()
    ok = out.join(docs, "doc_id").filter("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"))
    assert ok.agg(F.avg("ok")).first()[0] > 0.9
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in out.collect())
    plain = docs.select("doc_id", "text", "lang").collect()
    want = dict(zip((r.doc_id for r in plain), brute_langid([(r.text, r.lang) for r in plain if crc(r.doc_id, 5)], [r.text for r in plain]), strict=True))
    for r in out.collect():
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], rel=1e-6)


def test_op6(spark, data, rows):
    out = Q["op6_best_fit_packing"](spark, data).collect()
    total, fill = defaultdict(int), defaultdict(int)
    for r in out:
        total[r.doc_id] += r.n_tokens
        fill[r.bin_id] += r.n_tokens
    assert dict(total) == {i: len(tokens(t)) for i, t in rows} and max(fill.values()) <= 2048


def test_op6_places_best_fit(spark, data, docs):
    """Every piece of the registered query, in its order, against all open bins."""
    plain = docs.select("doc_id", "source", "text").collect()  # in the order of the file, so of row numbers
    out = {r.doc_id: [] for r in plain}
    for r in Q["op6_best_fit_packing"](spark, data).collect():
        out[r.doc_id].append((r.n_tokens, r.start_token, r.bin_id))
    replay_packing([(r.source, r.text) for r in plain], [out[r.doc_id] for r in plain])


def test_op7(spark, data, rows):
    from ridgeline.llm import license_scan

    index = license_scan.TemplateIndex()
    out = {r.doc_id: r for r in Q["op7_license_scan"](spark, data).collect()}
    assert set(out) == {i for i, _ in rows}
    for i, t in rows:
        w = re.findall(ALNUM, lower(t))
        at = [(s, label) for p, label in license_scan.BASE.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        r, labels = out[i], brute_license(index, w)
        spots = [s for s, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(spots, default=None), max(spots, default=None))
        assert r.base_labels == ",".join(sorted({k for _, k in at})) and (r.labels, r.score) == (labels[0], pytest.approx(labels[1]))


def test_op9(spark, data, rows):
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in Q["op9_simhash"](spark, data).collect()}
    f = np.array([brute_print(t) for _, t in rows], np.uint64)
    part = groups(len(rows), [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= 4)])
    assert out == {i: (f"{int(x):016x}", rows[g][0]) for (i, _), x, g in zip(rows, f, part, strict=True)}


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in Q) == list(range(1, 11))
