"""Repeated strings, near copies and near vectors against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gateledger.llm import capfilters, common, components, sigtrees, suffixindex
from tests.llm.helpers import as_dict, awkward, odd_texts, words


def brute_repeats(texts, length):
    seen, out = set(), {}
    for doc, text in sorted(texts):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            part = data[s:s + length]
            if part in seen:
                gone[s:s + length] = True
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeating_texts(seed=1):
    rng = random.Random(seed)
    passages = [words(rng, rng.randint(15, 60)) for _ in range(6)]
    texts = []
    for i in range(120):
        parts = [words(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut:], words(rng, rng.randint(0, 20))]
        if rng.random() < 0.15:
            parts.append("Shti " * rng.randint(10, 80))
        if rng.random() < 0.1 and texts:
            parts = [rng.choice(texts)[1]]
        texts.append((i * 3 - 50, " é".join(parts)))
    return texts


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_repeats_equal_brute_force(spark, batches):
    texts = repeating_texts(batches) + [(1000 + d, t) for d, t in odd_texts() if d != 4]
    docs = awkward(spark, texts).repartition(3)
    found = as_dict(suffixindex.remove_repeats(docs, batches=batches))
    want = brute_repeats(texts, 100)
    assert len(found) == len(want)
    for doc, row in want.items():
        r = found[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == row, doc


def test_crowded_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffixindex, "CROWDED", 3)
    texts = repeating_texts(9)
    found = as_dict(suffixindex.remove_repeats(awkward(spark, texts)))
    for doc, row in brute_repeats(texts, 100).items():
        r = found[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == row, doc


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(suffixindex, "PIECE", 3000)
    rng = random.Random(3)
    passage = words(rng, 700)
    texts = [(1, words(rng, 2000) + passage), (2, passage + words(rng, 3000) + passage), (3, "ab" * 9000)]
    found = as_dict(suffixindex.remove_repeats(awkward(spark, texts)))
    for doc, row in brute_repeats(texts, 100).items():
        r = found[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == row, doc


def test_levels_merge_like_a_counter(spark):
    index = suffixindex.LogIndex(spark)
    rng = random.Random(2)
    for k in range(5):
        index.add(awkward(spark, [(10 * k + i, words(rng, 50)) for i in range(5)]).select("doc_id", "text"))
    assert [rank for rank, _ in index.levels] == [2, 0]


def test_repeated_null_and_missing_rows(spark):
    rng = random.Random(7)
    text = words(rng, 60)
    found = suffixindex.remove_repeats(awkward(spark, [(5, text), (5, text), (None, text), (9, text)])).collect()
    removed = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in found)
    # the null id comes first, so all others repeat it
    assert removed == [(-1, 0), (5, len(text)), (5, len(text)), (9, len(text))]
    assert [r.n_removed for r in suffixindex.remove_repeats(awkward(spark, [(5, text), (5, text)])).collect()] == [0, 0]
    assert suffixindex.remove_repeats(awkward(spark, [])).count() == 0


def test_stripping_keeps_columns_and_whole_characters(spark):
    rng = random.Random(11)
    passage = "é" + words(rng, 60) + "ñ"
    texts = [(1, "ü" + passage), (2, "xé" + passage + "ö tail"), (3, None), (4, "")]
    docs = awkward(spark, texts)
    kept = suffixindex.strip_repeats(docs)
    assert kept.columns == docs.columns
    rows = as_dict(kept)
    assert rows[1].text == "ü" + passage and rows[3].text is None and rows[4].text == ""
    assert "�" not in rows[2].text and len(rows[2].text) < 20 and rows[2].text.startswith("x")


def brute_components(texts, num, den, size):
    sets = {}
    for doc, text in texts:
        w = (text or "").encode().lower().split()
        sets[doc] = frozenset([tuple(w)] if 0 < len(w) < size else zip(*(w[k:] for k in range(size))))
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            common = len(x & y)
            if common and den * common >= num * (len(x) + len(y) - common):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_copies(seed, n=160):
    rng = random.Random(seed)
    bases = [words(rng, rng.choice([3, 5, 12, 40, 90, 200])) for _ in range(12)]
    texts = []
    for i in range(n):
        w = rng.choice(bases).split() if rng.random() < 0.8 else words(rng, rng.randint(1, 90)).split()
        for _ in range(rng.randint(0, max(1, len(w) // 30))):
            w[rng.randrange(len(w))] = words(rng, 1)
        if rng.random() < 0.2:
            w = w[: max(1, int(len(w) * rng.uniform(0.85, 1)))]
        texts.append((i, " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    return texts


@pytest.mark.parametrize("seed,block", [(1, sigtrees.BLOCK), (2, 200)])
def test_join_equals_brute_force(spark, seed, block):
    texts = near_copies(seed) + [(1000 + d, t) for d, t in odd_texts()]
    found = as_dict(sigtrees.jaccard_components(awkward(spark, texts), block=block))
    want = brute_components(texts, 85, 100, 4)
    assert {d: (r.n_shingles, r.component_id) for d, r in found.items()} == want


def test_a_range_moves_only_its_sets(spark, monkeypatch):
    searched, join_trees = [], sigtrees.join_trees
    monkeypatch.setattr(sigtrees, "join_trees", lambda rows, *rest: searched.append(rows) or join_trees(rows, *rest))
    sigtrees.jaccard_components(awkward(spark, near_copies(1)))
    plans = [rows._jdf.queryExecution().optimizedPlan().toString() for rows in searched]
    # sets carry their trees; they are not joined with the table of all sets in each range
    assert len(plans) == sigtrees.SEARCH_RANGES and "Join" not in plans[0]
    assert sum(rows.count() for rows in searched) > 0


def test_sets_move_once_a_range_and_never_meet_their_trees_again(spark, monkeypatch):
    searched, join_trees = [], sigtrees.join_trees
    monkeypatch.setattr(sigtrees, "join_trees", lambda rows, *rest: searched.append(rows) or join_trees(rows, *rest))
    written, settled = [], sigtrees.settled
    monkeypatch.setattr(sigtrees, "settled", lambda df, *rest: written.append(df) or settled(df, *rest))
    texts = near_copies(6)
    found = as_dict(sigtrees.jaccard_components(awkward(spark, texts)))
    assert {d: (r.n_shingles, r.component_id) for d, r in found.items()} == brute_components(texts, 85, 100, 4)

    def above_sets(plan):
        """Names of the nodes between the root and the scan that has the sets."""
        if plan.children().isEmpty():
            return [] if "shingles" in plan.output().toString() else None
        for k in range(plan.children().size()):
            below = above_sets(plan.children().apply(k))
            if below is not None:
                return [plan.nodeName(), *below]
        return None

    for rows in searched:
        assert "Join" not in above_sets(rows._jdf.queryExecution().optimizedPlan())
    sets = next(df for df in written if "shingles" in df.columns)
    plan = sets._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "MapInArrow"  # nothing is joined to sets once they are made


def test_long_sets_are_compared_a_few_at_a_time(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 8000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[5 * k:], rng.integers(0, 2**63, 900, dtype=np.uint64)])) for k in range(40)]
    tree, widest, count = sigtrees.Tree(sets, sigtrees.words_for(sets)), [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: widest.append(x.nbytes) or count(x))
    joined = sigtrees.Joined(sigtrees.Union(len(sets)), [(tree, np.arange(len(sets)))])
    listed = {(min(x, y), max(x, y)) for i, j in sigtrees.search(tree, tree, 80, 100, joined) for x, y in zip(i.tolist(), j.tolist())}
    linked = {(x, y) for x in range(40) for y in range(x + 1, 40) if sigtrees.links(sets[x], sets[y], 80, 100)}
    assert linked and linked <= listed
    assert max(widest) <= 1 << 22


def test_sets_with_very_many_places_meet_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    met = [np.unique(rng.integers(0, 2**40, 3000)) for _ in range(400)]
    for k in range(0, 400, 7):
        met[k][0] = 5
    owner, place = np.repeat(np.arange(400), [len(m) for m in met]), np.concatenate(met)
    widest, zeros = [], np.zeros
    monkeypatch.setattr(np, "zeros", lambda *a, **b: widest.append((x := zeros(*a, **b)).nbytes) or x)
    stripe, right = np.arange(0, 100), np.arange(100, 400)
    found = sigtrees.meeting(stripe, right, owner, place)
    assert (found == ((stripe % 7 == 0)[:, None] & (right % 7 == 0)[None, :])).all()
    assert max(widest) <= 1 << 22


def test_the_pipeline_leaves_no_sets_behind(spark, monkeypatch):
    gone, dropped = [], sigtrees.dropped
    monkeypatch.setattr(sigtrees, "dropped", lambda session, path: gone.append(path) or dropped(session, path))
    kept = sigtrees.one_of_each(awkward(spark, near_copies(7, 40)))
    # names, shared trees and sets of pairs as soon as they are read, sets at the end
    assert len(gone) == 2 + sigtrees.NAME_RANGES + sigtrees.TEXT_RANGES and kept.count() > 0


def test_texts_that_only_share_a_line_move_no_sets(spark, monkeypatch):
    moved, settled = set(), sigtrees.settled

    def watched(df, *rest):
        out = settled(df, *rest)
        if "shingles" in out.columns:
            moved.update(r.rep for r in out.select("rep").collect())
        return out

    monkeypatch.setattr(sigtrees, "settled", watched)
    rng = random.Random(12)
    line = words(rng, 40)
    texts = [(i, f"{words(rng, 60)} {line} {words(rng, 50)}") for i in range(60)]
    texts += [(100 + i, texts[i][1] + " " + words(rng, 3)) for i in range(4)]
    found = as_dict(sigtrees.jaccard_components(awkward(spark, texts)))
    assert {d: (r.n_shingles, r.component_id) for d, r in found.items()} == brute_components(texts, 85, 100, 4)
    assert moved == {0, 1, 2, 3, 100, 101, 102, 103}


def test_sketches_name_every_link():
    rng = np.random.default_rng(7)
    for num, den in ((80, 100), (85, 100), (6, 10)):
        sets = []
        for _ in range(15):
            base = rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.uint64)
            for _ in range(int(rng.integers(1, 9))):
                copy = base[:max(1, int(len(base) * rng.uniform(0.7, 1)))].copy()
                at = rng.integers(0, len(copy), int(rng.integers(0, len(copy) // 4 + 1)))
                copy[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
                sets.append(np.unique(copy))
        sizes, n = np.array([len(s) for s in sets]), len(sets)
        sketches = sigtrees.Sketches([sigtrees.sketch(s) for s in sets], sizes, num, den)
        linked = np.array([[x != y and sigtrees.links(sets[x], sets[y], num, den) for y in range(n)] for x in range(n)])
        may = sketches.crossed(np.arange(n), np.arange(n))
        assert linked.any() and not (linked & ~may).any() and (num < 80 or may.sum() < n * n / 3)
        i, j = np.nonzero(np.ones((n, n), bool))
        assert (sketches.may_link(i, j).reshape(n, n) == may).all()
        order = rng.permutation(n)
        for left, right in ((order, order), (order[:n // 3], order[n // 3:])):
            left, right = (left, left) if len(left) == n else (left, right)
            across = np.zeros((n, n), bool)
            across[np.ix_(left, right)] = across[np.ix_(right, left)] = True
            found = sketches.partnered(left, right)
            assert not ((linked & across).any(axis=1) & ~found).any()
            np.fill_diagonal(across, False)
            assert not (found & ~(may & across).any(axis=1)).any()


def test_other_thresholds(spark):
    texts = near_copies(5, 90)
    found = as_dict(sigtrees.jaccard_components(awkward(spark, texts), num=6, den=10, shingle=2))
    assert {d: (r.n_shingles, r.component_id) for d, r in found.items()} == brute_components(texts, 6, 10, 2)


def test_one_of_each_keeps_columns(spark):
    texts = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (None, "q r s t u")]
    docs = awkward(spark, texts)
    kept = sigtrees.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 1, 3, 4]
    assert sigtrees.jaccard_components(awkward(spark, [])).count() == 0


def test_many_near_copies_list_few_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = []
    for _ in range(3000):
        copy = base.copy()
        copy[rng.integers(0, 200, 4)] = rng.integers(0, 2**63, 4, dtype=np.uint64)
        sets.append(np.unique(copy))
    tree, union = sigtrees.Tree(sets, sigtrees.words_for(sets)), sigtrees.Union(len(sets))
    listed = 0
    for i, j in sigtrees.search(tree, tree, 85, 100, sigtrees.Joined(union, [(tree, np.arange(len(sets)))])):
        listed += len(i)
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = union.root(x), union.root(y)
            if p != q and sigtrees.links(sets[x], sets[y], 85, 100):
                union.link(p, q)
    assert len(np.unique(union.roots())) == 1
    assert listed < 300_000  # of 4.5 million


def test_pruning_keeps_every_link():
    rng = np.random.default_rng(8)
    pool = [rng.integers(0, 2**63, 60, dtype=np.uint64) for _ in range(25)]
    sets = []
    for _ in range(400):
        copy = pool[int(rng.integers(25))].copy()
        at = rng.integers(0, 60, int(rng.integers(0, 9)))
        copy[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
        sets.append(np.unique(copy))
    halves = np.arange(150), np.arange(150, 400)
    words_ = sigtrees.words_for(sets)
    trees = [sigtrees.Tree([sets[i] for i in at], words_) for at in halves]
    union, want = sigtrees.Union(400), sigtrees.Union(400)

    def link(u, x, y):
        p, q = u.root(x), u.root(y)
        if p != q and sigtrees.links(sets[x], sets[y], 85, 100):
            u.link(p, q)

    for i, j in sigtrees.search(*trees, 85, 100, sigtrees.Joined(union, list(zip(trees, halves)))):
        for x, y in zip(halves[0][i].tolist(), halves[1][j].tolist()):
            link(union, x, y)
    for x in halves[0]:
        for y in halves[1]:
            link(want, int(x), int(y))
    assert first_seen(union.roots().tolist()) == first_seen(want.roots().tolist())


def first_seen(roots):
    first = {}
    return [first.setdefault(r, i) for i, r in enumerate(roots)]


def test_sets_that_meet_are_found_in_stripes():
    rng = np.random.default_rng(2)
    met = [np.unique(rng.integers(0, 40, 3)) for _ in range(90)]
    owner, place = np.repeat(np.arange(90), [len(m) for m in met]), np.concatenate(met)
    stripe, right = np.arange(10, 30), np.arange(40, 90)
    found = sigtrees.meeting(stripe, right, owner, place)
    assert (found == [[bool(set(met[i]) & set(met[j])) for j in right] for i in stripe]).all()


def test_segments_are_more_than_linked_sets_can_differ():
    router = sigtrees.Router(85, 100)
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 400))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        drop = int(rng.integers(0, n // 7 + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 14 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if sigtrees.links(a, b, 85, 100) and len(a) != len(np.intersect1d(a, b)):
            assert np.intersect1d(router.trees(a), router.trees(b)).size


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    path = list(range(100, 160))
    rng.shuffle(path)
    edges = [*zip(path, path[1:]), *[(7, i) for i in range(8, 40)], (3, 3), (2, 1)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 100 for i in path) and all(found[i] == 7 for i in range(8, 40)) and found[2] == 1
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_vectors(rng, n, dims, cosine):
    """Vectors and a partner of each at a given cosine."""
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((n, dims))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * y])


def vector_table(spark, x, more=()):
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")


def exact_links(x):
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = x @ x.T >= 0.95
    np.fill_diagonal(g, False)
    return g


def test_recall_at_the_threshold(spark):
    x = near_vectors(np.random.default_rng(3), 800, 48, 0.955)
    found = capfilters.link_vectors(vector_table(spark, x)).collect()
    links = exact_links(x).sum(axis=1)
    got = np.array([r.n_links for r in sorted(found, key=lambda r: r.vec_id)])
    assert (got <= links).all() and got.sum() >= 0.97 * links.sum()


@pytest.mark.parametrize("block", [1024, 8])
def test_groups_of_near_and_equal_vectors(spark, block):
    rng = np.random.default_rng(5)
    center = rng.standard_normal(32)
    x = np.concatenate([
        rng.standard_normal((60, 32)), center + 0.05 * rng.standard_normal((40, 32)), np.repeat(center[None], 5, axis=0)])
    more = [(900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [1.0, None] + [0.0] * 30, 1),
            (904, [float("nan")] * 32, 1), (905, [float("inf")] * 32, 1), (906, [1.0, 2.0, 3.0], 1), (907, [2.0, 4.0, 6.0], 1)]
    found = as_dict(capfilters.link_vectors(vector_table(spark, x, more), block=block), "vec_id")
    links = exact_links(x)
    for i in range(len(x)):
        assert found[i].n_links == links[i].sum(), i
        assert found[i].component_id == (60 if i >= 60 else i)
        assert found[i].kept == (i <= 60)
    for i in range(900, 906):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert (found[906].n_links, found[907].n_links, found[907].component_id) == (1, 1, 906)
    assert capfilters.link_vectors(vector_table(spark, [])).count() == 0


def chained(rng, lengths, dims, cosine):
    """Paths of vectors; each is linked with the ones beside it and with no others."""
    out = []
    for n in lengths:
        v = rng.standard_normal(dims)
        for _ in range(n):
            v = v / np.linalg.norm(v)
            out.append(v)
            step = rng.standard_normal(dims)
            step -= (step @ v) * v
            v = cosine * v + np.sqrt(1 - cosine**2) * step / np.linalg.norm(step)
    return np.array(out)


def least_by_links(links):
    least, was = np.arange(len(links)), None
    while was is None or (least != was).any():
        was = least
        least = np.minimum(was, np.where(links, was[None, :], len(links)).min(axis=1))
    return least


def test_chains_and_bridged_groups_are_one_component(spark):
    rng = np.random.default_rng(8)
    dims = 64
    # two groups around the ends of one link: nothing but that link joins them
    ends = chained(rng, [2] * 10, dims, 0.96)
    groups = np.concatenate([e + 0.004 * rng.standard_normal((6, dims)) for e in ends])
    x = np.concatenate([chained(rng, [4] * 30 + [9] * 10, dims, 0.97), groups])
    x = x[rng.permutation(len(x))]
    links = exact_links(x)
    want = least_by_links(links)
    # with so many caps a vector no pair is missed, so components must be exact
    found = as_dict(capfilters.link_vectors(vector_table(spark, x), caps=200.0, per_cap=40.0), "vec_id")
    assert [found[i].n_links for i in range(len(x))] == links.sum(axis=1).tolist()
    assert [found[i].component_id for i in range(len(x))] == want.tolist()
    assert [found[i].kept for i in range(len(x))] == (want == np.arange(len(x))).tolist()


def test_a_path_whose_ends_come_first_stays_whole(spark):
    # the links are 1-10, 10-11 and 11-2, all met in one filter
    x = chained(np.random.default_rng(2), [4], 64, 0.96)
    rows = [(7, 0, 0, 0, i, 1, v.tobytes(), [7]) for i, v in zip((1, 10, 11, 2), x, strict=True)]
    group = spark.createDataFrame(
        rows, "filter long, one long, two long, block long, rep long, copies long, unit binary, filters array<long>")
    edges = capfilters.compare(group.coalesce(1), 0.95)
    assert {r.rep: r.n_links for r in edges.collect()} == {1: 1, 2: 1, 10: 2, 11: 2}
    joined = components.components(edges.select(F.col("rep").alias("a"), F.col("least").alias("b"))).collect()
    assert {r.id: r.component for r in joined} == {1: 1, 2: 1, 10: 1, 11: 1}


def test_vectors_beyond_the_range_of_squares():
    import pyarrow as pa

    from gateledger.llm.capfilters import unit_rows

    rows = pa.array([[1e200, 1e200], [1e-200, 1.0001e-200], [0.0, 0.0], [float("inf"), 1.0], None], pa.list_(pa.float64()))
    at, unit = unit_rows(rows)
    assert at.tolist() == [0, 1] and float(unit[0] @ unit[1]) > 0.999999


def test_components_fill_few_files(spark, monkeypatch):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    written, write = [], common.durable_table
    monkeypatch.setattr(common, "durable_table", lambda df, path=None: written.append(write(df, path)) or written[-1])
    rng = random.Random(9)
    edges = [(rng.randrange(2000), rng.randrange(2000)) for _ in range(1200)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = components.components(spark.createDataFrame(edges, "a long, b long"))
        got = {r["id"]: r.component for r in found.collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    met = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in met}
    assert len(written) >= 5
    assert sum(len(t.inputFiles()) for t in written[1:]) < len(written)
