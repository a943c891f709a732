import collections
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwell.llm import exact_dedup, near_dedup, suffix_dedup

WORDS = [f"w{i}" for i in range(400)]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sha string, node int")


EDGE = [(1, None), (2, ""), (2, ""), (3, "Abc"), (4, "aBC"), (5, "É"), (6, "é"), (None, "abc"), (None, "only"), (7, "abc"), (7, "abc")]


def test_exact_groups(spark):
    out = exact_dedup.exact_groups(docs(spark, EDGE)).collect()
    assert len(out) == len(EDGE)
    by = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out)
    assert by == collections.Counter(
        [(1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, False), (3, 7, 5, False), (4, 7, 5, False), (None, 7, 5, False), (7, 7, 5, True), (7, 7, 5, False),
         (5, 5, 1, True), (6, 6, 1, True), (None, None, 1, True)]
    )
    assert next(r.text_sha256 for r in out if r.doc_id == 3) == hashlib.sha256(b"abc").hexdigest()
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_exact_dedup_keeps_columns(spark):
    out = exact_dedup.exact_dedup(docs(spark, EDGE))
    assert out.columns == ["doc_id", "text", "sha", "node"]
    assert sorted(map(repr, (r.doc_id for r in out.collect()))) == sorted(map(repr, [2, 7, 5, 6, None]))


def test_filter_never_misses_a_repeat(spark):
    r = random.Random(4)
    rows = [(i, str(r.randint(0, 300))) for i in range(600)]
    hashed = docs(spark, rows).select("doc_id", exact_dedup.text_hash().alias("sha"))
    n = collections.Counter(t for _, t in rows)
    for bits in (1 << 20, 500):
        marked, bloom = exact_dedup.possibly_repeated(hashed, bits_per_row=2, slice_bits=bits)
        marked = marked.collect()
        assert bloom.slices == (1 if bits > 500 else 3) and len(marked) == 600
        assert all(m.maybe for m in marked if n[dict(rows)[m.doc_id]] > 1)


def test_exact_groups_in_slices_and_of_hot_groups(spark):
    r = random.Random(6)
    rows = [(i, "hot" if i % 3 == 0 else str(r.randint(0, 400)) * 3) for i in range(900)] + [(7, "é" * 100_000), (8, "é" * 100_000)]
    want = {}
    for i, t in rows:
        want.setdefault(t, []).append(i)
    for options in ({}, {"slice_bits": 4000}):
        out = exact_dedup.exact_groups(docs(spark, rows), **options).collect()
        assert collections.Counter((x.doc_id, x.keep_id, x.group_size, x.kept) for x in out) == collections.Counter((i, max(want[t]), len(want[t]), i == max(want[t])) for i, t in rows)
        kept = exact_dedup.exact_dedup(docs(spark, rows), **options).collect()
        assert sorted((x.doc_id, x.text) for x in kept) == sorted((max(v), t) for t, v in want.items())
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def brute_removed(rows, depth):
    count = collections.Counter(d[i : i + depth] for d in rows for i in range(len(d) - depth + 1))
    out = []
    for d in rows:
        gone = [False] * len(d)
        for i in range(len(d) - depth + 1):
            if count[d[i : i + depth]] > 1:
                gone[i : i + depth] = [True] * depth
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark):
    r = random.Random(1)
    passage, line = prose(r, 200), prose(r, 40)
    rows = [(i, prose(r, 60) + (" " + passage[r.randint(0, 200) : r.randint(500, 900)] if i % 3 == 0 else "") + prose(r, 30)) for i in range(30)]
    rows += [(40, rows[0][1]), (41, "a" * 1500), (42, ("ab" * 40 + "\n") * 30), (43, line + "é" * 300 + line), (44, prose(r, 5) + "é" * 400)]
    rows += [(45, None), (46, ""), (47, "short"), (48, passage), (48, passage), (None, passage[100:700]), (50, passage[:399]), (51, passage[:400])]
    out = suffix_dedup.remove_repeats(docs(spark, rows)).collect()
    want = brute_removed([(t or "").encode() for _, t in rows], 400)
    assert sorted(repr(tuple(x)) for x in out) == sorted(repr((i, *w)) for (i, _), w in zip(rows, want, strict=True))
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_suffix_dedup_of_texts_longer_than_a_piece(spark):
    """A passage over a piece's border, one in two pieces of a text, and repeats on either side of the border."""
    r = random.Random(9)
    word = [f"v{i}" for i in range(50_000)]
    long = " ".join(r.choice(word) for _ in range(100_000))[: 2 * suffix_dedup.PIECE + 5000]
    border = suffix_dedup.PIECE
    rows = [(1, long), (2, "x " + long[border - 700 : border + 300]), (3, long[border - 400 : border] + "!"), (4, long[border : border + 400] + "?"), (5, long[100:800] + "#" + long[2 * border - 200 : 2 * border + 450])]
    wide = spark.createDataFrame([(i, t, 1, "d", "p") for i, t in rows], "doc_id long, text string, low int, data string, parts string")
    out = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.remove_repeats(wide).collect()}
    data = [t.encode() for _, t in rows]
    first = {}  # windows of the short texts, and where else they are
    for k, d in enumerate(data[1:], 1):
        for i in range(len(d) - 399):
            first.setdefault(d[i : i + 400], set()).add((k, i))
    gone = [[False] * len(d) for d in data]
    for i in range(len(data[0]) - 399):
        if data[0][i : i + 400] in first:
            first[data[0][i : i + 400]].add((0, i))
    for places in first.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + 400] = [True] * 400
    for (i, _), d, g in zip(rows, data, gone, strict=True):
        spans = sum(x and not (j and g[j - 1]) for j, x in enumerate(g))
        assert out[i] == (len(d), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(d, g, strict=True) if not x)).hexdigest())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 8))
@settings(max_examples=300, deadline=None)
def test_banded_distance(a, b, limit):
    assert near_dedup.banded_distance(a, b, limit) == min(edit_distance(a, b), limit + 1)


def test_near_classes(spark):
    r = random.Random(7)
    rows, line = [], prose(r, 15)
    for g in range(12):
        base = (prose(r, 150) if g % 2 else prose(r, 60) + " " + line).split()
        for c in range(4):
            words = base[:]
            for _ in range(c * len(base) // 60):
                words[r.randrange(len(words))] = r.choice(WORDS)
            rows.append((10 * g + c, " ".join(words)))
    rows += [(500 + i, prose(r, 80) + " " + line) for i in range(60)] + [(600, rows[0][1]), (601, None), (602, ""), (603, "two words"), (None, rows[4][1])]
    out = {(x.doc_id): (x.class_id, x.class_size, x.kept) for x in near_dedup.near_classes(docs(spark, rows)).collect()}
    text = {i: t or "" for i, t in rows}
    ids = [i for i, _ in rows]
    for i in ids:
        for j in ids:
            if i != j and near_dedup.similar(text[i], text[j]):
                assert out[i][0] == out[j][0]
    assert all(out[500 + i][:2] == (500 + i, 1) for i in range(60))
    assert out[600][0] == 0 and out[601][0] == out[602][0] == 601 and out[None][0] == 10
    kept = near_dedup.near_dedup(docs(spark, rows)).collect()
    assert {x.doc_id for x in kept} == {v[0] for v in out.values()}
    assert near_dedup.near_classes(docs(spark, [])).count() == 0


def test_original_joins_copies_that_differ_from_one_another(spark):
    r = random.Random(5)
    base, rows = [f"{w}{i}" for i, w in enumerate(prose(r, 200).split())], []
    for c in range(300):
        words = base[:]
        for at in r.sample(range(200), 24):
            words[at] = f"copy{c}x{at}"
        rows.append((c + 1, " ".join(words)))
    rows.append((1000, " ".join(base)))
    assert all(near_dedup.similar(t, rows[-1][1]) for _, t in rows)
    assert sum(near_dedup.similar(rows[i][1], rows[i + 1][1]) for i in range(0, 300, 2)) < 30
    out = near_dedup.near_classes(docs(spark, rows)).collect()
    assert max(x.class_size for x in out) >= 285


def test_links_at_the_limit_of_similarity(spark):
    r, rows = random.Random(13), []
    for words, changed, pairs in ((120, 21, 60), (120, 24, 60), (300, 59, 40), (20, 4, 40), (30, 6, 40), (1000, 190, 10)):
        for k in range(pairs):
            a = [f"w{r.randrange(10**6)}" for _ in range(words)]
            b = a[:]
            for at in r.sample(range(words), changed):
                b[at] = f"x{r.randrange(10**6)}"
            assert near_dedup.similar(" ".join(a), " ".join(b))
            rows += [(len(rows), " ".join(a), f"{words}/{changed}"), (len(rows) + 1, " ".join(b), f"{words}/{changed}")]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    size = {x.doc_id: x.class_size for x in near_dedup.near_classes(frame).collect()}
    for kind in {k for _, _, k in rows}:
        ids = [i for i, _, k in rows if k == kind]
        assert sum(size[i] == 2 for i in ids) >= 0.9 * len(ids), kind


def test_chained_distance_is_an_alignment():
    r = random.Random(2)
    for _ in range(200):
        a = [r.randrange(30) for _ in range(r.randrange(40))]
        b = [x if r.random() > 0.2 else r.randrange(30) for x in a if r.random() > 0.1]
        bound = near_dedup.chained_distance(*(near_dedup.np.array(v, near_dedup.np.uint64) for v in (a, b)))
        assert edit_distance(a, b) <= bound <= max(len(a), len(b))


def test_bins_never_rule_out_similar_texts():
    r, np = random.Random(4), near_dedup.np
    for n in (5, 40, 400):
        a = [f"w{r.randrange(200)}" for _ in range(n)]
        b = [x if r.random() > 0.15 else "other" for x in a]
        if near_dedup.similar(" ".join(a), " ".join(b)):
            x, y = (near_dedup.hashed(" ".join(v)) for v in (a, b))
            for p, q in ((near_dedup.bins(x), near_dedup.bins(y)), (None, near_dedup.bins(y)), (None, None)):
                assert near_dedup.may_be_similar(np.array([len(x)]), np.array([len(y)]), [p], [q]).all()
    assert near_dedup.bins(near_dedup.hashed("again " * 300)) is None


def test_near_dedup_keeps_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y"), (None, None, 3, "z")], "doc_id long, text string, _dropped int, node string")
    out = near_dedup.near_dedup(frame)
    assert out.columns == frame.columns and sorted(x["_dropped"] for x in out.collect()) == [1, 3]


def test_similar_texts_become_candidates():
    r = random.Random(6)

    def keys(words):
        text = " ".join(words)
        short = near_dedup.short_keys(text) if len(words) <= near_dedup.SHORT else []
        return set(enumerate(near_dedup.sketch(near_dedup.shingles(near_dedup.hashed(text))))) | {(near_dedup.BANDS, k) for k in short}

    for n, least in ((6, 1.0), (12, 1.0), (20, 1.0), (30, 1.0), (50, 0.92), (200, 0.92)):
        found = 0
        for _ in range(200):
            a = [f"w{r.randrange(10**6)}" for _ in range(n)]
            b = a[:]
            for at in r.sample(range(n), n // 5):
                b[at] = f"x{r.randrange(10**6)}"
            found += not keys(a).isdisjoint(keys(b))
        assert found >= least * 200


def test_similar_ignores_case_and_marks():
    text = prose(random.Random(8), 60)
    assert near_dedup.similar(text, text.upper())
    assert near_dedup.similar(text, ", ".join(f'"{w}"' for w in text.split()[:-5]) + " other")
    assert not near_dedup.similar(text, prose(random.Random(9), 60))


@pytest.mark.parametrize("words, common, edits", [(20, range(8), (8, 12, 16)), (60, range(20, 44), (2, 6, 10, 14, 18, 46, 50, 54, 58))])
def test_pairs_that_meet_in_crowds_alone_are_found_exactly(spark, words, common, edits):
    """All that the texts of a pair have in common of five words or more is in every text."""
    r, rows = random.Random(words), []
    for k in range(40):
        a = [f"averylongcommonword{i}" if i in common else f"w{r.randrange(10**6)}" for i in range(words)]
        b = [f"x{r.randrange(10**6)}" if i in edits else w for i, w in enumerate(a)]
        assert near_dedup.similar(" ".join(a), " ".join(b))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    rows += [(100 + i, f"{i}") for i in range(3)] + [(200, None), (201, "one two three four")]
    out = {x.doc_id: (x.class_id, x.class_size) for x in near_dedup.near_classes(docs(spark, rows)).collect()}
    assert all(out[i] == (i // 2 * 2, 2) for i in range(80)) and all(out[i] == (i, 1) for i in (100, 101, 102, 200, 201))


def test_similar_texts_share_a_sure_key():
    r, np = random.Random(3), near_dedup.np
    for n in (1, 2, 4, 5, 6, 9, 10, 11, 14, 19, 20, 24, 57, 100):
        for _ in range(100):
            a = [f"w{r.randrange(40)}" for _ in range(n)]
            b = a[:]
            for _ in range(r.randrange(n // 5 + 2)):
                at, kind = r.randrange(len(b) + 1), r.randrange(3)
                b[at : at + (kind > 0)] = [f"w{r.randrange(40)}"] * (kind < 2)
            x, y = (near_dedup.hashed(" ".join(v)) for v in (a, b))
            if len(y) and near_dedup.near(x, y):
                counts = np.zeros(near_dedup.SLOTS, np.uint16)
                np.add.at(counts, near_dedup.slots(np.concatenate([near_dedup.shingles(v, 2) for v in (x, y)])), 1)
                assert set(near_dedup.sure_keys(x, counts)) & set(near_dedup.sure_keys(y, counts))


def test_keys_of_many_roots_meet_alike_however_they_are_dealt(monkeypatch):
    """Texts that share a key with a few of another root meet those, with many the root; keys of too many rows go on as rows."""
    np = near_dedup.np
    #         node, root, bytes of the root, words, keys
    who = np.array([(1, 1, 10, 100, 2), (2, 2, 30, 110, 2), (3, 2, 30, 100, 1), (4, 4, 40, 200, 1), (5, 5, 10, 100, 1)], np.int64).T
    keys = np.array([7, 8, 7, 9, 7, 7, 8], np.uint64)

    def met():
        out = {"raw": set(), "other": set(), "leader": set()}
        for key, node, root, _, _, other, leader in near_dedup.roots_met(who, keys):
            kind, last = ("leader", leader) if leader is not None else ("other", other) if other is not None else ("raw", key)
            out[kind] |= set(zip(node.tolist(), last.tolist(), strict=True))
        return out

    assert met() == {"raw": set(), "other": set(), "leader": {(1, 2), (1, 3), (1, 5)}}
    monkeypatch.setattr(near_dedup, "FEW", 1)
    assert met() == {"raw": set(), "other": {(1, 2)}, "leader": {(1, 5)}}
    monkeypatch.setattr(near_dedup, "KEY_PAIRS", 5)
    assert met() == {"raw": {(1, 7), (2, 7), (3, 7), (4, 7)}, "other": set(), "leader": {(1, 5)}}


def test_texts_with_a_passage_in_common_are_told_apart_before_they_travel(spark):
    """Of texts that share a fifth, no pair is a row but the one that is similar."""
    r, common = random.Random(11), " ".join(f"c{i}" for i in range(12))
    rows = [(k, k, 400 + k, f"{common} " + " ".join(f"w{r.randrange(10**6)}" for _ in range(48))) for k in range(50)]
    rows.append((50, 50, 400, rows[7][3].replace("c3 ", "x3 ")))
    known, tmp = spark.createDataFrame(rows, "node long, root long, bytes long, text string"), near_dedup.Scratch()
    counts = tmp.keep(near_dedup._slot_counts(known.filter("node < 0")), "slots")
    met = near_dedup._met_roots(near_dedup._dealt_keys(known, counts._scratch, 4)).collect()
    tmp.drop(counts)
    assert met and {frozenset((x.node, x.leader)) for x in met} == {frozenset((7, 50))}


def test_marks_and_triples_never_rule_out_similar_texts():
    r, np, met = random.Random(5), near_dedup.np, 0
    for _ in range(400):
        a = [f"w{r.randrange(60)}" for _ in range(r.randrange(1, 120))]
        b = a[:]
        for _ in range(r.randrange(len(a) // 5 + 2)):
            at, kind = r.randrange(len(b) + 1), r.randrange(3)
            b[at : at + (kind > 0)] = [f"x{r.randrange(900)}"] * (kind < 2)
        x, y = (near_dedup.hashed(" ".join(v)) for v in (a, b))
        if len(y) and near_dedup.near(x, y):
            n, met = (np.array([len(x)]), np.array([len(y)])), met + 1
            assert near_dedup.marks_allow(*n, near_dedup.marks(x)[None], near_dedup.marks(y)[None]).all()
            shared = near_dedup.Triples([y, y[::-1]]).shared(x)
            assert shared[0] == len(np.intersect1d(near_dedup.shingles(x, 3), near_dedup.shingles(y, 3)))
            assert shared[0] >= near_dedup.triples_needed(*n)[0]
    assert met > 200


@pytest.mark.parametrize("words, share, edits", [(180, 0.5, 36), (180, 1 / 3, 34), (400, 0.6, 80)])
def test_near_pairs_among_texts_that_share_a_passage(spark, words, share, edits):
    """Pairs at the limit whose edits all lie outside a passage that every text has."""
    r = random.Random(words)
    known = [f"w{i}" for i in range(5000)]
    passage, rows = [r.choice(known) for _ in range(int(words * share))], []
    for k in range(60):
        own = [r.choice(known) for _ in range(words - len(passage))]
        at = r.randrange(len(own) + 1)
        a = own[:at] + passage + own[at:]
        b = a[:]
        for i in r.sample([i for i in range(words) if not at <= i < at + len(passage)], edits):
            b[i] = r.choice(known)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alike = [k for k in range(60) if near_dedup.similar(rows[2 * k][1], rows[2 * k + 1][1])]
    assert len(alike) > 50 and sum(got[2 * k] == got[2 * k + 1] for k in alike) >= 0.9 * len(alike)
    assert all(got[2 * k] == 2 * k for k in range(60))
