import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import WORD, lower
from test_dedup import brute_print

from ridgeline.llm import simhash, textkernel

TEXT = st.text(st.sampled_from("aB zé日\t\n\x0b\x1c\xa0　-9_É"), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_and_fingerprints(texts):
    raw, offsets = textkernel.utf8(pa.array(texts, pa.string()))
    got = {"space": [], "alnum": []}
    for _, _, data, at in textkernel.pieces(raw, offsets, 16):
        data = textkernel.LOWER[data]
        for name, table in (("space", textkernel.NOT_SPACE), ("alnum", textkernel.ALNUM)):
            starts, ends, word_at = textkernel.word_spans(data, at, table)
            for i in range(len(at) - 1):
                got[name].append([data[starts[w] : ends[w]].tobytes().decode() for w in range(word_at[i], word_at[i + 1])])
    assert got["space"] == [WORD.findall(lower(t)) for t in texts]
    assert got["alnum"] == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for t in texts]
    assert [int(x) for x in simhash.fingerprints(pa.array(texts, pa.string()))] == [brute_print(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=30))
def test_span_hashes_tell_spans_apart(spans):
    data = np.frombuffer(b"".join(spans), np.uint8)
    lengths = np.array([len(s) for s in spans])
    h = textkernel.span_hashes(textkernel.loads(data), np.cumsum(lengths) - lengths, lengths)
    assert len(set(h.tolist())) == len(set(spans))
    assert h.tolist() == [textkernel.hash_bytes(s) for s in spans]


@pytest.mark.parametrize("column", [pa.array([], pa.string()), pa.array([None, None], pa.string()), pa.chunked_array([["a", None], ["bc"]]), pa.array(["x", "yy", "zzz"]).slice(1)])
def test_views_of_columns(column):
    raw, offsets = textkernel.utf8(column)
    got = [raw[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)]
    assert got == [v or "" for v in column.to_pylist()]
