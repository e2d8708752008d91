"""Passages against brute force: all pairs of documents that have 50 words in a row in common must be in one component."""

import numpy as np
import pytest

from siftworks.llm.substring_dedup import SHINGLE, Combiner, Diagonals, Shingles, Text, compact_windows, grow, hashed, keyed_windows, repeated_passages, running, shared_passages, shingles, viable


def tree(values, least):
    out, todo = [], [(0, len(values))]
    while todo:
        i, j = todo.pop()
        if j - i >= least:
            at = i + int(values[i:j].argmin())
            out.append((i, at, j))
            todo += [(i, at), (at + 1, j)]
    return sorted(out)


@pytest.mark.parametrize("n", [0, 3, 5, 6, 40, 300])
@pytest.mark.parametrize("most", [5, 10**9])
def test_windows_are_the_wide_nodes_of_the_tree(n, most):
    v = np.random.default_rng(n).integers(1, most + 1, n).astype(np.uint64)
    found = compact_windows(np.concatenate([np.zeros(1, dtype=np.uint64), v]), 6) - 1
    assert sorted(map(tuple, found.tolist())) == tree(v, 6)


@pytest.mark.parametrize("n", [6, 40, 150])
@pytest.mark.parametrize("share", [0.3, 0.75, 0.9, 1.0])
def test_viable_places_and_growth_equal_trying_all_stretches(n, share):
    near, least = np.random.default_rng(n).random(n) < share, 6
    total = running(near, 0.8)
    good = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if total[j] - total[i] >= -1e-6]
    want = [any(i <= at < j and j - i >= least for i, j in good) for at in range(n)]
    assert viable(total, least).tolist() == want
    first, end = n // 4, n - n // 5
    for at in np.flatnonzero(near[first:end]) + first:
        i, j = grow(total, first, at, end)
        assert first <= i <= at < j <= end and total[j] - total[i] == max(total[q] - total[p] for p in range(first, at + 1) for q in range(at + 1, end + 1))


def test_equal_runs_stay_inside_both_windows():
    rng = np.random.default_rng(5)
    a, b = rng.integers(1, 3, 60).astype(np.uint64), rng.integers(1, 3, 45).astype(np.uint64)
    d = Diagonals(a, b)
    for at in range(60):
        for b_at in np.flatnonzero(b == a[at]).tolist():
            first, end, b_first, b_end = max(0, at - 9), min(60, at + 7), max(0, b_at - 5), min(45, b_at + 8)
            i, j = at, at + 1
            while i > first and i - at + b_at > b_first and a[i - 1] == b[i - 1 - at + b_at]:
                i -= 1
            while j < end and j - at + b_at < b_end and a[j] == b[j - at + b_at]:
                j += 1
            assert d.equal_run((0, first, at, end, b_first, b_at, b_end)) == (i, i - at + b_at, j - i)


def test_windows_of_all_hashes_equal_those_of_each():
    v = Shingles([" ".join(f"w{x}" for x in np.random.default_rng(1).integers(0, 40, n)) for n in (0, 3, 200, 90)]).value
    keys, rows = keyed_windows(v, 4, 6)
    for k in range(4):
        assert rows[rows[:, 0] == k][:, 1:].tolist() == compact_windows(hashed(v, k), 6).tolist()
    assert (keys.view(np.uint64) & np.uint64(7)).tolist() == rows[:, 0].tolist()


def test_texts_without_a_common_stretch_share_nothing():
    rng = np.random.default_rng(2)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 100_000, n))
    line, other = words(30), words(30)
    texts = [f"{words(80)} {line} {words(80)} {other}", f"{line} {words(90)} {other} {words(70)}", f"{words(10)} {line} {other} {words(10)}"]
    a, b, c = (Text(np.concatenate([[np.uint64(0)], shingles(t)]), 4, 46) for t in texts)
    assert shared_passages(a, b, 42, 2, 50, 0.8, SHINGLE) == [] and shared_passages(c, c, 42, 2, 50, 0.8, SHINGLE) == [(0, 80, 0, 80, 1.0)]


def test_texts_hash_alike_alone_and_in_a_slice():
    texts = ["", "One two three four five six", None, "a b", "Zażółć gęślą jaźń one two-three", "x " * 50, "\x00", "ONE two, three four. five SIX"]
    s = Shingles(texts)
    for k, t in enumerate(texts):
        assert s.value[s.start[k] : s.stop[k]].tolist() == shingles(t).tolist()
    assert shingles(texts[1]).tolist() == shingles(texts[-1]).tolist() and len(shingles(texts[1])) == 6 - SHINGLE + 1


def component(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_every_shared_run_of_fifty_words_is_linked(spark):
    rng = np.random.default_rng(7)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    line, passages = words(40), [words(50) for _ in range(6)]
    texts = []
    for k in range(120):
        # All have the line; some pairs have a passage right beside it, so their windows meet in one large group.
        parts = [words(int(rng.integers(20, 120))), line, passages[k % 6] if k % 3 == 0 else words(30), words(60)]
        if k % 10 == 0:
            parts += [line, words(15), line]
        texts.append(" ".join(w for p in parts for w in p))
    texts += [texts[0], texts[0], texts[5]]
    rows = [(k, t) for k, t in enumerate(texts)]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), block=4).collect()
    grams = [{" ".join(w[i : i + 50]) for i in range(len(w) - 49)} for w in (t.split() for t in texts)]
    want = [(a, b) for a in range(len(rows)) for b in range(a) if grams[a] & grams[b]]
    got = component([(r.doc_id, r.rep_doc_id) for r in found], range(len(rows)))
    assert want and all(got[a] == got[b] for a, b in want)
    for r in found:
        a, b = (texts[i].split()[x:y] for i, x, y in ((r.doc_id, r.start, r.end), (r.rep_doc_id, r.rep_start, r.rep_end)))
        x, y = ({" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} for w in (a, b))
        assert min(len(a), len(b)) >= 50 and len(x & y) / len(x | y) == pytest.approx(r.similarity) and r.similarity >= 0.8


def test_near_passages_are_found_and_clean_texts_left_alone(spark):
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    passage = words(200)
    edited = list(passage)
    edited[60] = edited[140] = "changed"
    texts = [words(100) + passage, words(30) + edited + words(50), words(300)]
    found = repeated_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.rep_doc_id) for r in found} == {(1, 0)}
    assert max(r.end - r.start for r in found) >= 150


def family(rng, words, size, n=80, cuts=4):
    """Copies of a passage that differ from it, and more from each other, by single words; the smallest id need not be like the others."""
    passage, out = words(n), []
    for _ in range(size):
        copy = list(passage)
        for at in rng.choice(n, int(rng.integers(0, cuts)), replace=False):
            copy[at] = words(1)[0]
        out.append(copy)
    return out


def test_edited_families_are_linked_as_by_all_pairs(spark):
    """Recall against all pairs, by similarity; families in which the smallest id is not like the others among them."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    texts, passages, line = [], [], words(30)
    for size in [2] * 20 + [3] * 20 + [8] * 6 + [40] * 2:
        for passage in family(rng, words, size):
            passages.append(passage)
            parts = [words(int(rng.integers(10, 60))), passage, words(int(rng.integers(10, 60)))]
            texts.append(" ".join(w for p in ([line] if rng.random() < 0.3 else []) + parts for w in p))
    order = rng.permutation(len(texts))
    texts, passages = [texts[i] for i in order], [passages[i] for i in order]
    grams = [{" ".join(p[i : i + SHINGLE]) for i in range(len(p) - SHINGLE + 1)} for p in passages]
    like = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in range(len(texts)) for b in range(a)}
    found = repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    got = component([(r.doc_id, r.rep_doc_id) for r in found], range(len(texts)))
    for low, high, least in ((0.8, 0.85, 0.93), (0.85, 0.95, 0.99), (0.95, 1.01, 1.0)):
        want = [pair for pair, x in like.items() if low <= x < high]
        lost = sum(got[a] != got[b] for a, b in want)
        print(f"similarity {low} to {high}: {len(want)} pairs, {lost} lost")
        assert len(want) > 50 and lost <= (1 - least) * len(want)
    assert len(set(found)) == len(found)
    assert all(grams[r.doc_id] & grams[r.rep_doc_id] for r in found)


def test_rows_of_frequent_keys_join_a_representative_of_the_task():
    """However the slices fall, all documents of a key are joined over representatives, and one row a key has none."""
    rng = np.random.default_rng(5)
    for held in (3, 1000):
        combine, rows, have = Combiner(frequent=2, held=held), [], {}
        for part in range(12):
            key, doc = rng.integers(0, 12, 40), rng.integers(100 * part, 100 * part + 90, 40)
            for k, d in zip(key.tolist(), doc.tolist()):
                have.setdefault(k, set()).add(d)
            rows += zip(*combine(key, doc, key % 4).to_pydict().values())
        assert {(k, d) for k, d, *_ in rows} == {(k, d) for k, ds in have.items() for d in ds}
        assert all(m == k % 4 and (r is None or n > 1) for k, _, r, m, n in rows)
        for k, ds in have.items():
            own = [(d, r) for x, d, r, _, _ in rows if x == k]
            low = min(d for d, r in own if r is None)
            joined = component([(d, low if r is None else r) for d, r in own], ds)
            assert len(set(joined.values())) == 1
            if held == 1000:
                assert sum(r is None for _, r in own) <= 2  # the first, or two if it came alone at first


def test_passages_of_odd_tables(spark, odd_docs, no_docs):
    assert repeated_passages(no_docs).count() == 0
    found = repeated_passages(odd_docs)
    assert found.columns == ["doc_id", "rep_doc_id", "start", "end", "rep_start", "rep_end", "similarity"]
    assert all(r.doc_id is None or r.doc_id > r.rep_doc_id for r in found.collect())


def test_every_text_of_an_id_and_those_without_one(spark):
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    passage, other = words(80), words(80)
    text = lambda *parts: " ".join(w for p in parts for w in p)
    rows = [(3, text(words(20), passage)), (4, text(words(200))), (4, text(passage, words(9))), (4, text(words(70))), (None, text(words(5), passage)), (None, text(other)), (None, text(other, words(3)))]
    rows += [(7, text(other)), (7, text(other)), (7, text(words(4), other)), (9, text(words(90))), (None, None), (11, None)]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    links = {(r.doc_id, r.rep_doc_id) for r in found}
    joined = component([(-1 if a is None else a, -1 if b is None else b) for a, b in links], [-1, 3, 4, 7, 9, 11])
    assert joined[3] == joined[4] == joined[-1] == joined[7] and joined[9] == 9 and joined[11] == 11
    assert all(r.doc_id != r.rep_doc_id or r.doc_id is None for r in found)
    assert all(r.rep_doc_id is None or r.doc_id is None or r.rep_doc_id < r.doc_id for r in found)
    assert all(r.rep_doc_id is not None or r.doc_id is None for r in found)


def test_a_group_whose_last_one_is_unlike_its_members(spark):
    """600 documents with one line in common; the last one has that line and what all others have in part."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    line, families = words(40), [words(70) for _ in range(30)]
    texts = [" ".join(words(30) + line + families[k % 30] + words(20)) for k in range(600)]
    texts.append(" ".join(w for f in [[*words(30)], line] + [f + words(8) for f in families] for w in f))
    found = repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = component([(r.doc_id, r.rep_doc_id) for r in found], range(len(texts)))
    assert len(set(got.values())) == 1
    assert all(r.rep_doc_id < r.doc_id for r in found)
