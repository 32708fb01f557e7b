import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.packing import class_bounds, class_report, harmonic_bins, pack, packing_audit, packing_report
from tessera.llm.tokens import encode, load_encoding, with_token_counts

SIZED = "doc_id long, n_tokens long"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=120), st.booleans())
def test_bins_follow_their_patterns(sizes, refined):
    sizes = np.array(sizes, np.int64)
    bins, pattern, bound = harmonic_bins(sizes, 50, refined)
    assert (sizes <= bound).all()
    if not len(sizes):
        return
    assert np.bincount(bins, bound).max() <= 50
    assert sorted(set(bins.tolist())) == list(range(bins.max() + 1))
    takes = {}
    for b in set(bins.tolist()):
        here = (bins == b) & (sizes > 0)
        takes.setdefault(int(pattern[bins == b][0]), set()).add(tuple(sorted(bound[here].tolist())))
        assert len(set(pattern[bins == b].tolist())) == 1
    assert all(len(t) == 1 for t in takes.values())


def test_plain_harmonic_counts_per_class():
    sizes = np.array([30] * 5 + [20] * 7 + [12] * 9)
    bins, _, bound = harmonic_bins(sizes, 60, refined=False)
    assert [np.bincount(bins[sizes == s]).max() for s in (30, 20, 12)] == [2, 3, 5]
    assert [len(set(bins[sizes == s])) for s in (30, 20, 12)] == [3, 3, 2]
    assert set(bound.tolist()) == {30, 20, 12}


@pytest.mark.parametrize("capacity", [1, 2, 7, 512, 2048, 8192])
def test_class_bounds_are_close_and_hold_the_reciprocals(capacity):
    plain, fine = class_bounds(capacity, False), class_bounds(capacity)
    assert {capacity // j for j in range(1, capacity + 1)} == set(plain.tolist()) <= set(fine.tolist())
    steps = np.diff(fine)
    assert (np.diff(plain) > 0).all() and ((steps == 1) | (steps <= fine[1:] / 64 + 1)).all()


def test_refined_classes_leave_little_space():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 513, 5000), rng.choice([260, 250, 130, 40], 4000), np.minimum(512, rng.lognormal(4, 1, 5000).astype(int) + 1)):
        plain, fine = (len(set(harmonic_bins(sizes, 512, r)[0].tolist())) for r in (False, True))
        least = int(np.ceil(sizes.sum() / 512))
        assert least <= fine <= plain and fine <= 1.03 * least


def check(df, sizes, capacity):
    rows = df.collect()
    used, seen = {}, {}
    for r in rows:
        used[r.bin] = used.get(r.bin, 0) + r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.n_tokens))
    assert max(used.values()) <= capacity
    assert set(seen) == set(sizes)
    for doc, pieces in seen.items():
        pieces.sort()
        assert sum(n for _, _, n in pieces) == (sizes[doc] or 0)
        assert [s for _, s, _ in pieces] == [i * capacity for i in range(len(pieces))]
        assert len(pieces) == 1 or sizes[doc] > capacity


def test_every_text_once_and_split_only_if_too_large(spark):
    rng = np.random.default_rng(3)
    sizes = {i: int(rng.choice([0, 3, 40, 99, 100, 101, 250, 1000])) for i in range(500)} | {900: None}
    df = pack(spark.createDataFrame(list(sizes.items()), SIZED), [("a", 100), ("b", 7)], block_items=64)
    check(df.where("pack_name = 'a'"), sizes, 100)
    check(df.where("pack_name = 'b'"), sizes, 7)
    audit = packing_audit(df, [("a", 100), ("b", 7)]).collect()
    assert len(audit) == 2 and all(r.n_over == r.n_misfits == r.n_off_pattern == 0 for r in audit)


def test_audit_sees_wrong_bins(spark):
    rows = [("a", 0, 0, 60, 1, 0, 0, 55), ("a", 0, 0, 60, 2, 0, 0, 61), ("a", 1, 0, 60, 3, 0, 0, 10)]
    df = spark.createDataFrame(rows, "pack_name string, bin long, pattern long, class_bound long, doc_id long, piece long, start long, n_tokens long")
    r = packing_audit(df, [("a", 100)]).first()
    assert (r.n_items, r.n_tokens, r.n_over, r.n_misfits, r.n_off_pattern) == (3, 126, 1, 2, 1)
    c = class_report(df).first()
    assert (c.n_items, c.n_bins, c.n_tokens) == (3, 2, 126)


def test_report_empty_and_bad_capacities(spark):
    df = spark.createDataFrame([(1, 60), (2, 40), (3, 50)], SIZED)
    r = packing_report(pack(df, [("a", 100)]), [("a", 100)]).first()
    assert (r.n_bins, r.n_items, r.n_tokens, r.fullest, r.fill) == (2, 3, 150, 100, 0.75)
    assert pack(spark.createDataFrame([], SIZED), [("a", 100)]).count() == 0
    assert pack(df, []).count() == 0
    with pytest.raises(ValueError):
        pack(df, [("a", 0)])


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 60, 5, 6), (1, 60, 5, 6)], SIZED + ", size long, piece long")
    assert pack(df, [("a", 100)]).count() == 2


def test_token_counts(spark):
    texts = ["", None, "Hello world", "a" * 50_000, "word " * 30_000, "<|endoftext|>", "ünï ç😀\n\n  x"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, N_TOKENS long")
    got = {r.doc_id: r[-1] for r in with_token_counts(df.drop("N_TOKENS")).collect()}
    whole = load_encoding()
    assert got == {i: len(whole.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="ab c\n'1.é ", max_size=300))
def test_pieces_do_not_change_tokens(text):
    from tessera.llm import tokens

    whole = load_encoding().encode_ordinary(text)
    assert [t for p in tokens._pieces(text, 20) for t in load_encoding().encode_ordinary(p)] == whole == encode(text)
