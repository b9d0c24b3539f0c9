"""Boosted trees, source audit and vector codes on tables with nulls, empty, long, tied and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from prefspark.llm import classifier, source_audit, vector_codes
from prefspark.llm.common import read

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, block int, counts binary, score double, h long, good int"


def table(spark, rows):
    """Rows (doc_id, text, lang, source) with columns that clash with names used inside."""
    return spark.createDataFrame([(*r, 7, "t", 1, None, 0.5, 3, None) for r in rows], DOCS).repartition(3)


def labels_table(spark, rows):
    return spark.createDataFrame([(*r, None, 1) for r in rows], "doc_id long, quality int, toxic int, good int")


# ---- 11 ----


def test_trees_against_recursion():
    r = np.random.default_rng(1)
    points = np.round(r.normal(size=(600, 5)), 1)
    good = (points[:, 0] + points[:, 1] ** 2 > 1).astype(float)
    model = classifier.fit(points, good, trees=20, depth=3)

    def walk(x):
        total = model.start
        for feature, above, value in zip(model.feature, model.above, model.value):
            node = 0
            while node < len(feature):
                edges = model.edges[feature[node]]
                node = 2 * node + (2 if sum(e <= x[feature[node]] for e in edges) > above[node] else 1)
            total += value[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    unseen = np.round(r.normal(size=(200, 5)) * 2, 1)
    assert np.allclose(model.scores(unseen), [walk(x) for x in unseen])
    assert ((model.scores(points) >= 0.5) == good).mean() > 0.97
    # More rounds only lower the loss on the rows that were fitted.
    loss = [-np.log(np.where(good == 1, p, 1 - p)).mean() for p in (classifier.fit(points, good, trees=n, depth=3).scores(points) for n in (1, 5, 20))]
    assert loss[0] > loss[1] > loss[2]


def test_first_split_is_the_best_one():
    r = np.random.default_rng(4)
    points = np.round(r.normal(size=(80, 3)), 1)
    good = (r.random(80) < 0.5).astype(float)
    model = classifier.fit(points, good, trees=1, depth=1, ridge=1.0, least=4)
    p = good.mean()
    g, h = p - good, np.full(80, p * (1 - p))
    bins, best = model.bins(points), None
    for f in range(3):
        for b in range(64):
            left = bins[:, f] <= b
            if min(left.sum(), (~left).sum()) >= 4:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                if best is None or gain > best[0] + 1e-9:
                    best = gain, f, b
    assert (model.feature[0, 0], model.above[0, 0]) == best[1:]
    left = bins[:, best[1]] <= best[2]
    assert np.allclose(model.value[0], [-0.1 * g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)])


def test_statistics_of_odd_texts():
    named = lambda t: dict(zip(classifier.FEATURES, classifier.statistics(t)))
    assert not any(classifier.statistics(None)) and not any(classifier.statistics(b""))
    text = "ab Ab ab Ab\nXY 12 ##\n\nXY 12 ##\n".encode()
    x = named(text)
    assert x["upper_words"] == 2 / 10 and x["letterless_words"] == 4 / 10 and x["repeated_lines"] == 1 / 3
    assert x["distinct_words"] == 5 / 10 and x["top_word"] == 2 / 10 and x["words_per_line"] == 10 / 3
    assert x["repeated_pairs"] == (2 + 2 + 2) / 10 and x["same_as_before"] == 0
    assert named("é é".encode())["beyond_ascii"] == 2 / 3 and len(classifier.statistics(b"x " * 300_000)) == len(classifier.FEATURES)


def test_quality_scores(spark):
    odd = [(None, None, None, None), (None, "text", "en", "s"), (3, None, None, None), (4, "", "en", None), (5, "x" * 200_000, "en", "s"), (6, "same", "", ""), (6, "same", "", ""), (6, "other", "", "")]
    r = random.Random(2)
    texts = [" ".join(r.choice(["one", "two", "three", "four"]) + ("###" if i % 2 else "") for _ in range(60)) for i in range(200)]
    docs = table(spark, [*odd, *((100 + i, t, "en", "s") for i, t in enumerate(texts))])
    marks = labels_table(spark, [*((100 + i, 1 - i % 2) for i in range(200)), (100, 1), (3, None), (None, 0), (6, 1), (6, 0)])
    rows = classifier.score_quality(docs, marks).collect()
    assert len(rows) == len(odd) + 200 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in rows)
    assert all(x.held_out == (zlib.crc32(("" if x.doc_id is None else str(x.doc_id)).encode()) % 5 == 0) for x in rows)
    held = [x for x in rows if x.held_out and (x.doc_id or 0) >= 100]
    assert len(held) > 20 and all((x.score > 0.5) == (x.doc_id % 2 == 0) for x in held)
    # Labels of the held-out fold, languages and sources have no say.
    flipped = labels_table(spark, [(x, 1 - q if zlib.crc32(str(x).encode()) % 5 == 0 else q) for x, q in [*((100 + i, 1 - i % 2) for i in range(200)), (6, 1), (6, 0)]])
    again = classifier.score_quality(docs.drop("lang", "source"), flipped)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert classifier.score_quality(docs.where("false"), marks).count() == 0
    assert {x.score for x in classifier.score_quality(docs, marks.where("false")).collect()} == {0.5}


def test_sample_is_bounded_and_held_out_accuracy(spark):
    docs, marks = read(spark, SF, "documents"), read(spark, SF, "labels")
    x, y = classifier.training_rows(docs, marks, "doc_id", "text", 5, 0, 50, 1)
    assert len(x) == len(y) <= 50
    truth = {r.doc_id: r.quality for r in marks.collect()}
    held = [r for r in classifier.score_quality(docs, marks).collect() if r.held_out and r.doc_id in truth]
    bad = [r.score for r in held if truth[r.doc_id] == 0]
    good = [r.score for r in held if truth[r.doc_id] == 1]
    area = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert area > 0.97 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


# ---- 12 ----


def audit(rows, min_docs, ranks):
    """The contract in plain Python."""
    clean = [tuple(x or "" for x in r[1:4]) for r in rows]
    docs, said = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in clean:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        docs[lang].update(set(found))
        said[lang, source].update(found)
    out = []
    for lang in docs:
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=lambda t: t.encode())
        groups = sorted(g for g in said if g[0] == lang)
        count = {g: {t: said[g][t] for t in kept} for g in groups}
        whole = {t: sum(count[g][t] for g in groups) for t in kept}
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {g: p_of(count[g]) for g in groups}, p_of(whole)
        for g in groups:
            pairs = [(-sum(abs(p[g][t] - p[o][t]) for t in kept), o[1].encode(), o[1]) for o in groups if o != g]
            above = [(q[t] - p[g][t], t.encode(), t) for t in kept if count[g][t] and p[g][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(above)[:ranks])):
                out += [(*g, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def audited_rows():
    r = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "été", "Été", "naïve", "delta", "x", "日本", "ab\x7fcd", "re4d", "ß"]
    texts = [" ".join(r.choice(words[: 2 + i % 11]) for _ in range(r.randrange(1, 40))) for i in range(150)]
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{r.randrange(5)}") for i, t in enumerate(texts)]
    rows += [(200, None, "en", "silent"), (201, "", "fr", "only"), (202, "12 ?!", "fr", None), (203, "rare", "it", "one"), (None, None, None, None), (None, "beta " * 50_000, "en", None)]
    return rows + [(7, texts[7], "de", "s1")] * 40 + [(300 + i, "Alpha beta", "en", "copies") for i in range(60)]


@pytest.mark.parametrize(
    "options",
    [{}, {"keys_per_block": 2, "bytes_per_pass": 60, "dense_bytes": 8, "chunk_sources": 2}, {"min_docs": 1, "keys_per_block": 3, "ranks": 2}, {"bytes_per_block": 10, "chunk_sources": 1}],
)
def test_audit(spark, options):
    rows = audited_rows()
    options = {"min_docs": 8, "ranks": 4} | options
    got = source_audit.audit_sources(table(spark, rows), **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audit(rows, options["min_docs"], options["ranks"])


def test_audit_without_terms(spark):
    docs = table(spark, audited_rows())
    assert source_audit.audit_sources(docs.where("false")).count() == 0
    rows = [(1, "a", "en", "x"), (2, None, "en", "y"), (3, "", "de", "z")]
    got = sorted(map(tuple, source_audit.audit_sources(table(spark, rows)).collect()))
    assert got == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_perfect_hash_is_minimal_and_verified():
    keys = [f"key{i}".encode() for i in range(5000)]
    h = source_audit.digests(keys)
    of = h[:, 0].view(np.int64) % 4
    built = [source_audit.build_block([k for k, b in zip(keys, of) if b == block]) for block in range(4)]
    index = source_audit.HashBlocks(10, [b[0] for b in built], [b[1] for b in built], [pa.array(b[2], pa.binary()) for b in built])
    slots = index.slots(pa.array(keys, pa.binary()), of + 10, h)
    assert sorted(slots) == list(range(5000))
    assert [index.keys[int(s)].as_py() for s in slots[:50]] == keys[:50]
    others = [f"other{i}".encode() for i in range(5000)]
    h = source_audit.digests(others)
    # Without the comparison of stored keys many of them would be counted.
    assert (index.slots(pa.array(others, pa.binary()), h[:, 0].view(np.int64) % 4 + 10, h) == -1).all()
    assert (index.slots(pa.array(keys, pa.binary()), of + 3, source_audit.digests(keys)) == -1).all()
    assert source_audit.build_block([]) == ([], b"", [])


def test_shares_are_exact():
    for counts, total, kinds in (([0, 3, 10**12], 10**12 + 3, 3), ([0, 5 * 10**14], 5 * 10**14, 2), ([7, 10**16], 10**16 + 7, 2)):
        want = [1 + 10**9 * (c + 5) // (total + 5 * kinds) for c in counts]
        assert source_audit.shares(np.array(counts), total, kinds).tolist() == want
    for top in (0, 255, 256, 65536, 1 << 40):
        a = np.array([0, top])
        assert source_audit.unpack(source_audit.pack(a)).tolist() == a.tolist()


# ---- 13 ----


def coded(rows, parts=8, entries=16, rounds=6):
    """The contract in plain Python: rows (id, vector, label) that are kept."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = max((len(r[1]) for r in kept), default=0)
    length = -(-longest // parts)
    whole = [[math.floor(4096 * x) for x in r[1]] + [0] * (parts * length - len(r[1])) for r in kept]
    cut = lambda v, p: tuple(v[p * length : (p + 1) * length])
    first = {}
    for r, v in sorted(((r, v) for r, v in zip(kept, whole) if r[0] is not None), key=lambda x: (x[0][0], x[0][1])):
        first.setdefault(r[0], v)
    books = [[cut(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, book: min((far(v, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for v in whole:
                held[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [tuple(sum(x) // len(held[k]) for x in zip(*held[k])) if held[k] else c for k, c in enumerate(books[p])]
    found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for v in whole]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for r, e in zip(kept, errors):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], digest) for r, f, e in zip(kept, found, errors)]


VECTORS = "vec_id long, embedding array<float>, label int, ids binary, code string, of_label int, x int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, None, "c", 1, 2) for r in rows], VECTORS).repartition(3)


def vector_rows(n, dims, seed):
    r = np.random.default_rng(seed)
    return [(i, (np.round(r.normal(size=dims) * 8) / 64).tolist(), (None, 1, 2)[i % 3]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000}, {"rounds": 0}, {"rounds": 2, "entries": 3}])
def test_codes(spark, options):
    nan, inf = float("nan"), float("inf")
    rows = vector_rows(120, 24, 1)
    rows += [(500, None, 1), (501, [None] * 24, 1), (502, [nan] * 24, 2), (503, [1.0] * 23 + [inf], None), (504, [-inf] + [0.0] * 23, 1)]
    # Copies, ties between entries, a repeated id, ids that are null, short and empty vectors.
    rows += [(600 + i, rows[2][1], 5) for i in range(40)] + [(3, [0.25] * 24, None), (3, rows[3][1], 3), (None, [0.5] * 24, 3), (None, [], None), (-1, [0.125] * 5, 9)]
    plain = {k: v for k, v in options.items() if k != "block_bytes"}
    got = vector_codes.encode_vectors(vectors(spark, rows), **options)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(coded(rows, **plain), key=repr)


def test_codes_of_large_components_and_few_rows(spark):
    rows = [(i, [float(i * 3000 + j) for j in range(16)], 1) for i in range(30)]
    for some in (rows, rows[:1], [(5, [], None)]):
        got = sorted(map(tuple, vector_codes.encode_vectors(vectors(spark, some)).collect()))
        assert got == sorted(coded(some))
    empty = vector_codes.encode_vectors(vectors(spark, rows).where("false"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="63 bits"):
        vector_codes.encode_vectors(vectors(spark, [(1, [1e30] * 8, 1)]))


def test_settled_parts_see_moved_entries_only():
    r = np.random.default_rng(3)
    for trial in range(60):
        parts, book = r.integers(-3, 4, (200, 2)), r.integers(-3, 4, (9, 2))
        every = np.ones(9, bool)
        code, stored, n = vector_codes.assign(parts, book, every, None, None, True)
        assert n == 200 * 9
        after, moved = book.copy(), r.random(9) < 0.3
        after[moved] += r.integers(-1, 2, (moved.sum(), 2))
        moved = (after != book).any(axis=1)
        got = vector_codes.assign(parts, after, moved, code, stored, bool(trial % 2))
        want = ((parts[:, None] - after) ** 2).sum(axis=2)
        assert (got[0] == want.argmin(axis=1)).all() and (got[1] == want.min(axis=1)).all()
        assert got[2] == moved[code].sum() * 9 + (~moved[code]).sum() * moved.sum()


def test_later_passes_compare_less(spark):
    table_ = read(spark, "/root/testdata/sf0.01", "embeddings")
    n = table_.count() * 8 * 16
    assert vector_codes.Codes(table_, "vec_id", "embedding", "label", rounds=0).compared() == n
    assert vector_codes.Codes(table_, "vec_id", "embedding", "label", rounds=12).compared() < n / 2
