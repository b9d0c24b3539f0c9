"""The parts that run inside tasks, against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from prefspark.llm import chat, common as C, hmm, html_extract as H, line_dedup as L, ngram_join as N, packing as P, quality as Q, warc as W

rnd = random.Random(7)


# ---- HTML ----


def lcs_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def is_subsequence(part, whole):
    it = iter(whole)
    return all(x in it for x in part)


@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14))
@settings(max_examples=300, deadline=None)
def test_alignment_is_a_longest_common_subsequence(a, b):
    places = H.shared_lines(a, b)
    assert places == sorted(set(places)) and len(places) == lcs_length(a, b)
    assert is_subsequence([a[i] for i in places], b)


def test_halved_alignment_of_long_pages():
    a = [rnd.randrange(300) for _ in range(12_000)]
    b = [x for x in a if rnd.random() < 0.9] + a[:200]
    places = H.shared_lines(a, b)
    assert is_subsequence([a[i] for i in places], b) and len(places) >= 0.88 * len(a)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header class="top">Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">Cookies <b>ok</b>?</div>
<!-- ad --><article><h1>Title &amp; more</h1><p><b>One<br><p>Two
   &lt;b&gt; &copy;</p><div class="ad">Buy</div><form><p>Mail</p></form><aside>Aside</aside>
<section id="comments"><article class="comment">First!</article></section><p hidden>x</p><p>Last</article><footer>Foot</footer></body></html>"""


def test_article_of_a_page():
    assert H.main_text(PAGE, [0, 1, 2]) == "Title & more\nOne\nTwo <b> ©\nLast"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a<p>b", "a\nb"),
        ("<div class='sidebar'><p>x</div>kept", "kept"),
        ("<main><div>in</div></main><div>out</div>", "in"),
        ("<div id=content>in</div><div>out</div>", "in"),
        ("<div class='has-sidebar'>in</div>", "in"),
        ("<article><header><h1>T</h1></header>b</article>", "T\nb"),
        ("<p>1 < 2 <x", "1 < 2 <x"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ("<script>never closed", ""),
        ("</div></p>stray", "stray"),
    ],
)
def test_markup(html, text):
    assert H.main_text(html, None) == text


def test_template_lines_leave_pages_without_an_article():
    page = "<body><div>Home</div><p>News</p><div>Imprint</div></body>"
    assert H.main_text(page, [0, 2]) == "News"


# ---- packing ----


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=200, deadline=None)
def test_packing_places_every_token_once(lengths):
    sequences = P.pack_lengths(lengths, 64, 4)
    seen = Counter()
    for sequence in sequences:
        held = sum(n for _, _, n in sequence)
        assert 0 < held <= 64 and (held > 64 - 4 or held & (held - 1) == 0)
        for item, start, n in sequence:
            assert n > 0
            seen.update((item, start + k) for k in range(n))
    assert seen == Counter((i, k) for i, n in enumerate(lengths) for k in range(n))


@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_tournament_is_first_fit(sizes):
    tree, room = P.Bins(50, len(sizes)), [50] * len(sizes)
    for size in sizes:
        want = next(i for i, r in enumerate(room) if r >= size)
        room[want] -= size
        assert tree.place(size) == want


@pytest.fixture(scope="module")
def encoder():
    pytest.importorskip("public_tokenizers")
    return P.Encoder(P.tokenizer_path())


def test_ids_are_made_without_places_in_the_text():
    """The encoder asks the tokenizer for ids alone, and gets those of the plain call."""
    encoder = P.Encoder(P.tokenizer_path())
    plain = encoder.tokenizer

    class IdsOnly:
        encode_batch_fast = staticmethod(plain.encode_batch_fast)

    encoder.tokenizer = IdsOnly()
    texts = ["One two, 3x one's", "", "naïve\xa0two\x1cthree", "日本 one", "<|endoftext|> one", "one two one"]
    got = [np.frombuffer(ids, np.uint16).tolist() for ids in encoder.encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


TEXT = st.text(alphabet=st.one_of(st.characters(max_codepoint=255), st.sampled_from("abcAB'st 1\n.,"), st.sampled_from("́ΣςİΩ한é　 ﬁⅧ‍𝒳")), max_size=40)


@given(st.lists(TEXT, max_size=5))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_tokenizers(encoder, texts):
    texts = [*texts, "don't <|endoftext|>x", "<|STARTOFTEXT|> it'S", "Dr. O'Neil’s 42nd café"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, np.uint16).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


# ---- chat ----


@given(st.text(alphabet="<|\\ab\n>im_start", max_size=30), st.text(alphabet="<|\\ab\nn>", max_size=12))
@settings(max_examples=500, deadline=None)
def test_turns_round_trip(text, role):
    formatted, start, end = chat.format_turn(role, chat.escape(text))
    assert formatted.count(chat.END) == 1 and formatted.count(chat.START) == 1
    assert chat.parse_turn(formatted) == (role, text)
    assert chat.unescape(formatted[start:end]) == text


def test_parts_become_ordered_placeholders():
    blank = dict.fromkeys(["text", "ref", "width", "height", "seconds", "pages"])
    parts = [
        {**blank, "type": "text", "text": "See <|image:0|> "},
        {**blank, "type": "image", "ref": "a.png", "width": 57, "height": 28},
        {**blank, "type": "audio", "ref": "b.wav", "seconds": 1.5},
        None,
        {**blank, "type": "document", "ref": "c.pdf", "pages": 3},
        {**blank, "type": "text", "text": None},
    ]
    visitor = chat.PartVisitor()
    assert visitor.flatten(parts) == r"See <\|image:0|> <|image:0|><|audio:1|><|document:2|>"
    assert [(a["nth"], a["kind"], a["ref"], a["tokens"]) for a in visitor.attachments] == [
        (0, "image", "a.png", 3), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 768)
    ]
    assert visitor.flatten(None) == "" and visitor.attachments == []
    with pytest.raises(ValueError):
        visitor.flatten([{**blank, "type": "video"}])


# ---- quality ----


def slow_counts(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(hit)


@given(st.text(alphabet="ab |#\n\t é", max_size=80))
@settings(max_examples=500, deadline=None)
def test_rule_counts(text):
    assert Q.rule_counts(text)[:5] == slow_counts(text)


def test_counts_of_nothing_and_of_very_much():
    assert Q.rule_counts(None) == (0,) * 8
    assert Q.rule_counts("ab " * 200_000)[:5] == (200_000, 400_000, 0, 0, 200_000)


def test_forest_isolates_odd_points():
    rng = np.random.default_rng(1)
    usual = rng.normal(size=(500, 3))
    forest = Q.IsolationForest(usual, 100, 256, 1)
    scores = forest.score(np.concatenate([usual, [[8, 8, 8], [-9, -9, 7]]]))
    assert scores[-2:].min() > np.quantile(scores[:-2], 0.99)
    # Path lengths by walking each tree.
    kind, split, left, right, path = forest.trees[0]
    for point in usual[:50]:
        at = 0
        while kind[at] >= 0:
            at = left[at] if point[kind[at]] < split[at] else right[at]
        alone = Q.IsolationForest.__new__(Q.IsolationForest)
        alone.trees, alone.scale = forest.trees[:1], 1.0
        assert -math.log2(alone.score(point[None])[0]) == pytest.approx(path[at])


def test_threshold_keeps_clean_rows():
    good, bad = np.zeros(101), np.zeros(101)
    good[10:50] = 25
    good[90] = 1
    bad[70:95] = 4
    cut = Q.best_threshold(good, bad, 0.002, 1.0)
    assert 49 / 4096 < cut < 71 / 4096


# ---- hidden Markov model ----


def slow_likelihood(chain, classes):
    alpha = chain.start * chain.emit[:, classes[0]]
    for c in classes[1:]:
        alpha = (alpha @ chain.move) * chain.emit[:, c]
    return math.log(alpha.sum())


def test_forward_recursion_and_baum_welch():
    rng = np.random.default_rng(2)
    prior = rng.dirichlet(np.ones(9))
    chain = hmm.Chain.first(prior, 3, 0.8, 1.0, 4)
    texts = [rng.integers(0, 9, n) for n in (1, 2, 5, 5, 17, 30)]
    for some, block, lengths in hmm._blocks(texts, 40):
        got = chain.likelihoods(block, lengths)
        assert got == pytest.approx([slow_likelihood(chain, texts[i]) for i in some])
    # Expected counts by all state paths of a short text.
    text = np.array([3, 1, 3, 7])
    block, lengths = text[:, None], np.array([4])
    start, moves, emitted, height = chain.expected(block, lengths)
    paths, total = Counter(), 0.0
    import itertools

    for path in itertools.product(range(3), repeat=4):
        p = chain.start[path[0]] * math.prod(chain.move[a, b] for a, b in itertools.pairwise(path)) * math.prod(chain.emit[s, c] for s, c in zip(path, text))
        total += p
        paths[path] = p
    assert height == pytest.approx(math.log(total))
    assert moves[0, 1] == pytest.approx(sum(p * sum((a, b) == (0, 1) for a, b in itertools.pairwise(x)) for x, p in paths.items()) / total)
    assert emitted[2, 3] == pytest.approx(sum(p * ((x[0] == 2) + (x[2] == 2)) for x, p in paths.items()) / total)
    assert start[1] == pytest.approx(sum(p for x, p in paths.items() if x[0] == 1) / total)
    # Rounds never lower the likelihood (without a prior's weight).
    heights = []
    for _ in range(6):
        sums = [0, 0, 0]
        height = 0.0
        for _, block, lengths in hmm._blocks(texts, 10_000):
            *part, h = chain.expected(block, lengths)
            sums, height = [a + b for a, b in zip(sums, part)], height + h
        heights.append(height)
        chain = chain.updated(*sums, prior, 1e-9)
    assert all(b >= a - 1e-2 for a, b in zip(heights, heights[1:])) and heights[-1] > heights[0]


def test_long_texts_count_as_whole_ones():
    rng = np.random.default_rng(5)
    chain = hmm.Chain.first(rng.dirichlet(np.ones(9)), 3, 0.8, 1.0, 4)
    texts = [rng.integers(0, 9, n) for n in (1, 7, 8, 14, 15, 50)]

    def counts(segment):
        sums = [0, 0, 0, 0]
        for _, block, seen, start, moves, height in hmm._passes(chain, texts, segment, 40):
            sums = [a + b for a, b in zip(sums, (start, moves, hmm.by_state(block, seen, 9), height))]
        return sums

    whole = counts(1000)
    assert whole[0].sum() == pytest.approx(len(texts)) and whole[1].sum() == pytest.approx(sum(len(t) - 1 for t in texts), rel=1e-5)
    for segment in (1, 7, 49):
        for a, b in zip(counts(segment), whole):
            assert a == pytest.approx(b, rel=1e-4, abs=1e-4)
    added = [np.zeros((1, 3)), np.zeros((3, 3)), np.zeros((3, 9)), np.zeros((1, 1))]
    for part in hmm._expected([texts[:2], texts[2:]], chain, 7, 40):
        for kind, i, j, value in zip(*(c.to_pylist() for c in part.columns)):
            added[kind][i, j] += value
    for a, b in zip(added, whole):
        assert a.reshape(-1) == pytest.approx(np.reshape(b, -1), rel=1e-4, abs=1e-4)


# ---- WARC ----


def test_records_round_trip_whatever_they_hold():
    html = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\n" + "é" * 10
    data = W.page_record(7, "http://a.b/c d\r\nX: y", html, None, None) + W.page_record(None, None, None, 5, None) + W.page_record(-3, "u", html, 0, 7)
    (_, n, first, block), (_, _, second, empty), (at, _, third, head) = W.parse_records(data)
    assert block == W.HTTP + html.encode() and empty == W.HTTP and head == W.HTTP and at > n
    assert first["warc-target-uri"] == "http://a.b/c%20d%0D%0AX:%20y" and "warc-target-uri" not in second
    assert W._page(third["warc-refers-to"]) == 7 and W._page(second["warc-record-id"]) is None
    assert third["x-payload-length"] == str(len(html.encode())) and third["warc-payload-digest"] == first["warc-payload-digest"]
    with pytest.raises(ValueError):
        list(W.parse_records(data[:-3]))


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
@settings(max_examples=300, deadline=None)
def test_loser_tree_merges(lists):
    assert list(W.merge_runs([sorted(x) for x in lists], lambda x: x)) == sorted(sum(lists, []))


def test_url_keys():
    assert W.url_key("http://www.Blog.example.com:80/A?b=1#c") == "com,example,blog)/a?b=1"
    assert W.url_key(None) == "" and W.url_key("http://[bad/") == "http://[bad/"


# ---- perfect hash ----


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(1 << 62), 1 << 62, (n, 2))
    h1, h2 = keys[:, 0].copy(), keys[:, 1].copy()
    sizes, bits, slots = L.build_index(h1.view(np.uint64), h2.view(np.uint64))
    assert sorted(slots) == list(range(n))
    order = np.argsort(slots)
    index = L.Index(sizes, bits, h2[order].tobytes(), np.arange(n).tobytes(), h1[order].tobytes())
    assert (index.slots(h1, h2) == slots).all()
    other = rng.integers(-(1 << 62), 1 << 62, (500, 2))
    assert (index.slots(other[:, 0].copy(), other[:, 1].copy()) == -1).all()


def test_line_keys():
    line = "Ä" + "Xy" * 30
    assert L.line_key(" \t" + line + "\v\r", 40) == L.line_key("Ä" + "xy" * 30, 40) != L.line_key("ä" + "xy" * 30, 40)
    assert L.line_key("x" * 39 + " ", 40) is None and L.line_key(" " + "x" * 39, 40) is not None


# ---- T-occurrence ----


def components(n, pairs):
    forest = N.Forest(n)
    for a, b in pairs:
        forest.union(a, b)
    return [forest.find(i) for i in range(n)]


def test_links_against_all_pairs():
    for k in range(200):
        base = [rnd.sample(range(400), rnd.randrange(1, 60)) for _ in range(4)]
        sets = []
        for _ in range(rnd.randrange(2, 25)):
            some = list(rnd.choice(base))
            for _ in range(rnd.randrange(4)):
                some[rnd.randrange(len(some))] = rnd.randrange(400)
            sets.append(np.unique(np.array(some, np.uint64)))
        sides = [rnd.randrange(2) for _ in sets] if k % 2 else None
        percent = rnd.choice([50, 85, 100])
        sets = [np.unique(s * np.uint64(0x9E3779B97F4A7C15)) for s in sets]  # spread over all buckets
        distinct = {s.tobytes(): s for s in sets}
        every = np.concatenate(list(distinct.values()))
        buckets = every >> np.uint64(64 - N.BUCKETS)
        rarity = N.Rarity.of({int(b): N.region(int(b), every[buckets == b]) for b in set(buckets.tolist())}) if k % 10 == 0 else None
        want = set()
        for i in range(len(sets)):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if (sides is None or sides[i] != sides[j]) and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    want.add((j, i))
                    if rarity and sets[i].tobytes() != sets[j].tobytes():
                        first = [set(rarity.prefix(s, percent).tolist()) for s in (sets[i], sets[j])]
                        assert first[0] & first[1], "linked sets share a prefix shingle"
        got = N.linked_pairs(sets, sides, percent, spanning=False)
        assert {tuple(sorted(p)) for p in got} == want and len(got) == len(want)
        assert components(len(sets), N.linked_pairs(sets, sides, percent)) == components(len(sets), want)


@given(st.lists(st.lists(st.integers(0, 15), unique=True), max_size=8), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_merge_skip(lists, needed):
    counts = Counter(x for values in lists for x in values)
    assert dict(N.merge_skip([sorted(x) for x in lists if x], needed)) == {v: c for v, c in counts.items() if c >= needed}


def test_shingles():
    size = lambda text: len(N.shingles(text, 4, {}))
    assert [size(x) for x in (None, "", " \n", "a", "a b c", "a b c d", "a b c d e", "A b c D a B c d")] == [0, 0, 0, 1, 1, 1, 2, 4]
    assert (N.shingles("a b", 4, {}) != N.shingles("b a", 4, {})).all()
    assert hashlib.md5(N.shingles("X y z w v", 4, {}).tobytes()).digest() == hashlib.md5(N.shingles("x Y z w v", 4, {}).tobytes()).digest()


def test_a_task_gives_its_memory_back_when_it_ends(monkeypatch):
    """Also a task that is not read to its end or fails."""
    called = []
    monkeypatch.setattr(C.ctypes, "CDLL", lambda name: type("Libc", (), {"malloc_trim": staticmethod(called.append)}))
    assert list(C.lean(lambda batches: (b for b in batches))(iter([1, 2]))) == [1, 2] and called == [0]
    begun = C.lean(lambda batches: (1 // b for b in batches))(iter([1, 0]))
    assert next(begun) == 1 and called == [0]
    with pytest.raises(ZeroDivisionError):
        next(begun)
    assert called == [0, 0]
