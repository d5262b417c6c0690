"""Properties that hold for any input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.llm import html_text, packing, simhash, token_store, toxicity, weighted_minhash


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500))
def test_token_files_round_trip(ids):
    array = np.array(ids, "<u4")
    file = token_store.TokenFile(token_store.pack(0, np.array([5], np.int64), np.array([len(ids)], np.int64), array))
    assert file.all().tolist() == ids
    assert all(file[i] == ids[i] for i in range(0, len(ids), 97))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plans_place_each_piece_once(histogram):
    taken = {}
    for length, a, b, first, offset in packing.plan(histogram, 64):
        assert 0 <= offset and offset + length <= 64
        for k in range(a, b):
            taken.setdefault(length, []).append(k)
        for k in range(b - a):
            places = taken.setdefault(("sequence", first + k), [])
            assert sum(places) == offset
            places.append(length)
    assert all(sorted(taken.get(n, [])) == list(range(c)) for n, c in histogram.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<pre>", "a b", "\n", "&amp;", "<!--", "-->", "<", "<script>", "</script>", "<br/>", "<b", ">", "\"", "é"]), max_size=40))
def test_any_markup_renders(parts):
    text = html_text.page_text("".join(parts))
    assert "\x00" not in text and not text.endswith("\n")


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_text_functions_take_any_text(text):
    assert 0 <= simhash.fingerprint(text) < 2**64
    assert len(weighted_minhash.fingerprint(text)) == 2 * weighted_minhash.SAMPLES
    assert all(w and not w.isspace() for w in toxicity.distinct_words(text))
    assert weighted_minhash.edited(text, text[::-1])[: len(text) - len(text) // 4] == text[: len(text) - len(text) // 4]
