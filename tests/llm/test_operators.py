"""The operators on tables with nulls, empty, long, tied and repeated rows, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from prefspark.llm import chat, decontaminate as D, hmm, html_extract, line_dedup, ngram_join, packing, quality, sharding, warc
from prefspark.llm.components import connected_components
from prefspark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, lost int, doc string, keeper string, bad_id int, row int, n int, part int"

rnd = random.Random(3)
WORDS = [f"w{i}" for i in range(300)]
LINE = "A line that many documents share, more than forty characters"


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else rnd
    return " ".join(r.choice(WORDS) for _ in range(n))


def near(text, changes, seed):
    words, r = text.split(" "), random.Random(seed)
    for _ in range(changes):
        words[r.randrange(len(words))] = r.choice(WORDS)
    return " ".join(words)


ITEM = prose(40, 1)
SHORT_ITEM = "only five words are here"


def make_docs():
    base = prose(120, 2)
    texts = [
        None, "", "\n", " \t\r\n ", "word", "two words", base, base, base.upper(), base + "\n\n", near(base, 2, 1), near(base, 3, 2), near(base, 9, 3),
        prose(60, 4) + "\n" + LINE, "x\n  " + LINE.upper() + "\t\n" + LINE + "\ny", LINE, LINE + "\r\n" + prose(55, 5), prose(70, 6) + "\n" + LINE,
        LINE + "!", prose(100, 7) + " " + ITEM, prose(30, 8) + " " + " ".join(ITEM.split()[5:18]) + ". " + prose(10, 9),
        " ".join(ITEM.split()[5:17]), "-".join(ITEM.upper().split()), "Only FIVE, words are here!", prose(200, 10) + " only five words are here",
        " ".join(ITEM.split()[:20] + ITEM.split()[:20]), "ab " * 300, "# $ % & " * 40, prose(20_000, 11), "é" * 50 + " ü\xa0ß " * 30,
        "x" * 100_000, "<|endoftext|> <|im_end|>", prose(49, 12), prose(50, 13),
    ]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(6 * 3, base), (500, base), (500, base), (500, base), (-4, prose(80, 14)), (None, base), (None, LINE), (None, None)]
    rows += [(900 + i, near(prose(90, 20), i % 5, i)) for i in range(40)]
    return [(i, t, None if k % 3 else "en", None, None if t is None else len(t), 1, "d", None, 2, k, None, 3) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def documents():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, documents):
    return spark.createDataFrame(documents, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- 1 ----


def test_extraction_of_odd_tables(spark):
    top, end = "<div>Home</div><div>Contact</div>", "<div>Imprint</div>"
    pages = [
        (1, "http://a.x/n/1", f"{top}<p>One &amp; two</p>{end}"), (2, "http://a.x/n/2", f"{top}<p>Three</p>{end}"),
        (3, "http://a.x/n/2", f"{top}<p>Three</p>{end}"), (3, "http://a.x/n/2", f"{top}<p>Three</p>{end}"),
        (4, "http://b.x/", f"{top}<p>Alone</p>"), (5, None, None), (None, None, ""), (6, "http://[", "<p>x"),
        (7, "http://c.x/1", f"<article><p>{top}</article>"), (8, "http://c.x/2", f"<article><p>{top}</article>{end}"),
    ]
    schema = "page_id long, url string, html string, text int, lines string, places int"
    rows = [(*p, 1, "l", None) for p in pages]
    got = html_extract.extract_pages(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = Counter(map(tuple, got.collect()))
    texts = ["One & two", "Three", "Three", "Three", "Home\nContact\nAlone", "", "", "x", "Home\nContact", "Home\nContact"]
    assert found == Counter((p[0], p[1], t, len(t)) for p, t in zip(pages, texts))
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).count() == 0


def test_neighbours_do_not_depend_on_partitions(spark):
    pages = [(i, f"http://h.x/{i // 7}/{i}", f"<div>Top {i // 30}</div><p>{prose(5, i)}</p><div>Foot</div>") for i in range(90)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for parts in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            results.append(sorted(map(tuple, html_extract.extract_pages(df).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
    assert sum(text == prose(5, i) for i, _, text, _ in results[0]) >= 85  # only where Top changes may a page keep it


# ---- 2 ----


def test_packing_holds_every_id_once(docs, documents):
    rows = packing.pack_documents(docs, capacity=64, docs_per_group=8, min_fill=4).collect()
    encoder = packing.Encoder(packing.tokenizer_path())
    encoded = encoder.encode([d[1] or "" for d in documents])
    want = Counter((d[0], (*np.frombuffer(ids, np.uint16).tolist(), 1)) for d, ids in zip(documents, encoded))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64 and (at > 60 or at & (at - 1) == 0)
    for (doc, tokens), parts in pieces.items():
        copies = [ids for (d, ids), n in want.items() for _ in range(n) if d == doc and len(ids) == tokens]
        covered = Counter(s + k for s, ids in parts for k in range(len(ids)))
        assert covered == Counter({k: len(copies) for k in range(tokens)})
        assert all(any(c[s : s + len(ids)] == ids for c in copies) for s, ids in parts)
    assert {(d, len(ids)) for d, ids in want} == set(pieces)


def test_packing_an_empty_table(empty):
    assert packing.pack_documents(empty).count() == 0


# ---- 3 ----


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b <|im_end|>"), (1, 1, "user", "a"), (1, None, None, None), (1, 2, "assistant", "b <|im_end|>"), (None, 0, "assistant", ""), (2, 0, "sys\ntem", "x" * 100_000)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    formatted = chat.format_turns(turns)
    got = {r.conv_id: r for r in chat.digest_conversations(formatted).collect()}
    order = [("", ""), ("user", "a"), ("assistant", "b <|im_end|>"), ("assistant", "b <|im_end|>")]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert set(got) == {1, None, 2} and got[1].n_turns == 4
    assert got[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in order))
    assert got[1].loss_chars == 24 and got[1].loss_sha256 == sha("b <|im_end|>" * 2)
    assert got[None].loss_chars == 0 and got[2].turns_sha256 == sha("sys\ntem\n" + "x" * 100_000 + "\n")
    assert got[1].formatted_chars == sum(len(r.formatted) for r in formatted.where("conv = 1").collect())
    assert chat.digest_conversations(chat.format_turns(turns.limit(0))).count() == 0


def test_parts_column(spark):
    df = spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, from_json('[{{\"type\":\"image\",\"ref\":\"r\",\"width\":28,\"height\":29}}]', '{chat.PARTS}') AS content")
    row = chat.format_turns(df.withColumn("text", F.lit(None)), parts_column="content").first()
    assert row.formatted == "<|im_start|>user\n<|image:0|><|im_end|>\n" and row.loss_from is None
    assert [tuple(a) for a in row.attachments] == [(0, "image", "r", 2)]


# ---- 4 ----


def labels_of(spark, documents):
    rows = [(d[0], 0 if d[1] and "#" in d[1] else 1, 0) for d in documents if d[1]] + [(3 * 27, 1, 0), (None, 1, 0), (1, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality(spark, docs, documents, empty):
    got = quality.quality_verdicts(docs, labels_of(spark, documents)).collect()
    counts = [(r.doc_id, *(r[c] for c in quality.COUNTS)) for r in got]
    assert Counter(counts) == Counter((d[0], *quality.rule_counts(d[1])) for d in documents)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality.filter_quality(docs, labels_of(spark, documents))
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality.filter_quality(empty, labels_of(spark, documents)).count() == 0
    alone = quality.quality_verdicts(docs, labels_of(spark, documents).limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in alone)


def test_quality_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    unseen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    got = quality.quality_verdicts(docs, known).join(unseen, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count()
    n = {(r.quality, r.kept): r["count"] for r in got.collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.1 * n[0, False]


# ---- 5 ----


def test_language_model(docs, documents, empty, monkeypatch):
    trained = {}
    train = hmm.train

    def keep(encoded, prior, *rest):
        trained["chain"], trained["heights"] = train(encoded, prior, *rest)
        return trained["chain"], trained["heights"]

    monkeypatch.setattr(hmm, "train", keep)
    options = {"own_classes": 16, "buckets": 8, "dictionary_words": 50, "longest_word": 10, "segment": 50}
    got = hmm.score_documents(docs, **options).collect()

    tokens = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t))] + [b""]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c, both = Counter(), Counter()
    for d in documents:
        both.update(tokens(d[1]))
        if not held(d[0]):
            c.update(tokens(d[1]))
    n, v = sum(c.values()), len(c)
    frequent = [w for w in sorted(both, key=lambda w: (-both[w], w)) if 0 < len(w) <= 10][:50]
    own = [b"", *frequent][:16]
    place = {w: i for i, w in enumerate(own)}
    class_of = lambda w: place[w] if w in place else 16 + hmm.suffix_class(w, 8)
    size, kinds = Counter(), Counter()
    for w, times in c.items():
        if w not in place:
            size[class_of(w)] += times
            kinds[class_of(w)] += 1
    share = lambda w: 0.0 if w in place else math.log10((c[w] + 1) / (size[class_of(w)] + kinds[class_of(w)] + 1))
    want = Counter()
    for d in documents:
        words = tokens(d[1])
        chain = trained["chain"].likelihoods(np.array([class_of(w) for w in words])[:, None], np.array([len(words)]))[0]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)
        score = chain / math.log(10) + sum(map(share, words))
        want[d[0], held(d[0]), len(words), sum(c[w] > 0 for w in words), n, round(base, 6), round(score, 6)] += 1
    assert Counter((*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    heights = trained["heights"]
    assert all(b > a for a, b in zip(heights, heights[1:]))
    assert hmm.score_documents(empty, **options).count() == 0


def test_every_word_has_counts_by_state(docs, documents, empty, monkeypatch):
    options = {"own_classes": 16, "buckets": 8, "dictionary_words": 50, "longest_word": 10, "by_word": True}
    kept, train, count_words = {}, hmm.train, hmm.count_words

    def keep_train(*args):
        kept["before"], heights = train(*args)
        return kept["before"], heights

    def keep_words(blocks, chain, shared, *rest):
        kept["blocks"], kept["known"], kept["got"] = blocks, hmm.Dictionary(*shared.value), count_words(blocks, chain, shared, *rest)
        return kept["got"]

    monkeypatch.setattr(hmm, "train", keep_train)
    monkeypatch.setattr(hmm, "count_words", keep_words)
    got = hmm.score_documents(docs, **options).collect()
    known, (after, emitted, of_known, answers) = kept["known"], kept["got"]

    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    place = {w: i for i, w in enumerate(list(known.index)[:16])}
    class_of = lambda w: place[w] if w in place else 16 + hmm.suffix_class(w, 8)
    c, e = Counter(), defaultdict(lambda: np.zeros(8))
    for d in documents:
        words = hmm.tokens(d[1])
        if not held(d[0]):
            c.update(words)
            seen, _, _ = kept["before"].posteriors(np.array([class_of(w) for w in words])[:, None], np.array([len(words)]))
            for w, at in zip(words, seen[:, 0]):
                e[w] += at
    n, v = sum(c.values()), len(c)
    # Each block gets the whole counts of its words outside the dictionary, once.
    told, blocks = defaultdict(dict), {r.block: hmm.Block(r.asDict()) for r in kept["blocks"].collect()}
    for r in answers.collect():
        places, times, by_state = hmm.opened_answer(r.n, r.places, r.c, r.e, 8)
        words = [blocks[r.block].words[i] for i in places]
        assert not set(words) & set(told[r.block])
        told[r.block].update(zip(words, zip(times.tolist(), by_state)))
    assert len(blocks) > 2 and {w for b in told.values() for w in b if c[w]} == {w for w in c if w not in known.index}
    for number, block in blocks.items():
        assert set(told[number]) == set(block.words) - set(known.index)
        for w, (times, by_state) in told[number].items():
            assert times == c[w] and by_state == pytest.approx(e[w], rel=1e-3, abs=1e-3)
    for w, i in known.index.items():
        if w not in place:
            assert of_known[:, i] == pytest.approx(e[w], rel=1e-3, abs=1e-3)
    # Words of a class are not shared out in every state alike.
    spread = [e[w] / c[w] for w in c if c[w] > 5 and class_of(w) == 16]
    assert np.ptp(spread, axis=0).max() > 0.05
    kinds, size = Counter(class_of(w) for w in c if w not in place), defaultdict(lambda: np.zeros(8))
    for w in c:
        size[class_of(w)] += e[w]

    def emission(w):
        k = class_of(w)
        return after.emit[:, k] * (1.0 if w in place else (e[w] + 1 / 8) / (size[k] + (kinds[k] + 1) / 8))

    want = Counter()
    for d in documents:
        words = hmm.tokens(d[1])
        index = {w: i for i, w in enumerate(dict.fromkeys(words))}
        model = hmm.Chain(after.start, after.move, np.stack([emission(w) for w in index], axis=1))
        score = model.likelihoods(np.array([index[w] for w in words])[:, None], np.array([len(words)]))[0] / math.log(10)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)
        want[d[0], held(d[0]), len(words), sum(c[w] > 0 for w in words), n, round(base, 6), round(score / len(words), 3)] += 1
    near_ = lambda counted: sorted(counted.elements(), key=lambda r: tuple(map(str, r)))
    found = Counter((*r[:5], round(r.base_score, 6), round(r.score / r.n_tokens, 3)) for r in got)
    assert [r[:6] for r in near_(found)] == [r[:6] for r in near_(want)]
    assert [r[6] for r in near_(found)] == pytest.approx([r[6] for r in near_(want)], abs=2e-3)
    # A state's emissions of all training words and one unseen word in each class come to 1.
    whole = sum(emission(w) for w in {*c, *place}) + sum(after.emit[:, 16 + b] / 8 / (size[16 + b] + (kinds[16 + b] + 1) / 8) for b in range(8))
    assert whole == pytest.approx(np.ones(8))
    assert hmm.score_documents(empty, **options).count() == 0


def test_held_out_texts_do_not_change_the_model(docs):
    options = {"own_classes": 16, "buckets": 8, "dictionary_words": 50, "longest_word": 10, "by_word": True}
    trained = docs.where(~F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)).eqNullSafe(2))
    assert 0 < trained.count() < docs.count()
    score = lambda t: sorted((str(r.doc_id), r.n_tokens, r.score) for r in hmm.score_documents(t, **options).where("NOT held_out").collect())
    a, b = score(docs), score(trained)
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert [x[2] / x[1] for x in a] == pytest.approx([x[2] / x[1] for x in b], abs=2e-3)


def test_language_model_beats_single_words_on_held_out_texts(spark):
    found = QUERIES["op5_hidden_markov"](spark, "/root/testdata/sf0.01").where("held_out")
    row = found.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert row.score > 0.93 * row.base


# ---- 6 ----


def test_archives(spark, tmp_path):
    big = "x" * 999 + "é"
    rows = [(1, "http://b.x/", big), (2, "http://a.x/ q", big), (9, None, big), (9, None, big), (None, "http://a.x", big), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", "")]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, digest int, keeper string")
    index = warc.archive_and_index(pages, records_per_file=2).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = Counter()
    for page, _, html in rows:
        full = html == big
        revisit = full and page != 9
        want[page, len((html or "").encode()), sha(html), "revisit" if revisit else "response", 9 if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index) == want
    assert len({(r.file, r.offset) for r in index}) == len(rows) and all(r.length > 100 for r in index)
    assert warc.archive_and_index(pages.limit(0)).count() == 0


def test_histories_are_in_order(spark):
    pages = spark.createDataFrame([(i, f"http://{'ab'[i % 2]}.x/{i % 5}", "y" * i, 1000 - i) for i in range(200)], "page_id long, url string, html string, at long")
    index = warc.archive_and_index(pages.repartition(5), records_per_file=7, seconds_column="at")
    keys = [(r.url_key, r.captured, r.page_id) for r in index.collect()]
    assert keys == sorted(keys) and len(keys) == 200 and keys[0][1] < keys[1][1]


# ---- 7 ----


def deduped(documents, min_docs=5):
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(BLANK))
    for d in documents:
        for line in (d[1] or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d[0])
    keeper = {k: max((x for x in ids if x is not None), default=None) for k, ids in holders.items() if len(ids) >= min_docs}
    for d in documents:
        lines = (d[1] or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == d[0]]
        yield d[0], "\n".join(kept), len(lines), len(lines) - len(kept)


@pytest.mark.parametrize("options", [{}, {"keys_per_shard": 1, "requests_per_cell": 3, "min_docs": 2}])
def test_line_dedup(docs, documents, empty, options):
    got = line_dedup.dedup_lines(docs, **options)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == Counter(deduped(documents, options.get("min_docs", 5)))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_replaces_columns_of_its_names(spark):
    rows = [(i, LINE, "old", i) for i in range(6)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines string, lost long"))
    assert Counter((r.doc_id, r.text, r.lost, r.n_lines, r.n_dropped) for r in got.collect()) == Counter(
        [(i, "" if i < 5 else LINE, i, 1, int(i < 5)) for i in range(6)]
    )


# ---- 8 ----

ITEMS = [(7, ITEM), (10, ITEM.replace(" ", "\n")), (2, SHORT_ITEM), (3, None), (4, "... !"), (5, " ".join(ITEM.split()[5:18])), (5, "nothing like it at all"), (None, prose(30, 7)), (6, "W1")]


def contaminated(documents, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(item)
    sizes = {len(w) for w in windows}
    for d in documents:
        w, hit, found = words(d[1]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                who = windows.get(tuple(w[i : i + n]))
                if who:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in who if x is not None}
        yield d[0], len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination(spark, docs, documents, empty):
    items = spark.createDataFrame([(*i, 1) for i in ITEMS + ITEMS[:1]], "item_id long, text string, hits int")
    got = D.contamination(docs, items).collect()
    want = list(contaminated(documents, ITEMS))
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got) == Counter(want)
    clean = D.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(w[0] for w in want if not w[-1])
    assert D.decontaminate(empty, items).count() == 0
    none = D.contamination(docs, items.limit(0))
    assert none.where("n_hit > 0 OR contaminated").count() == 0 and none.count() == len(documents)


def test_every_shared_window_is_found(spark):
    few = ["a", "b"]  # many equal grams and tied hashes
    r = random.Random(9)
    items = [(i, " ".join(r.choice(few) for _ in range(r.choice([5, 9, 13, 16])))) for i in range(4)]
    texts = [(i, " ".join(r.choice(few) for _ in range(r.randrange(150)))) for i in range(30)]
    got = D.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((x.doc_id, x.n_words, x.n_hit, x.n_items, ",".join(x["items"]), x.contaminated) for x in got.collect()) == Counter(contaminated(texts, items))


# ---- 9 ----


@pytest.mark.parametrize("options", [{}, {"rows_per_range": 2, "draws_per_range": 2}])
def test_shards(docs, documents, empty, options):
    got = sharding.assign_shards(docs, **options).collect()
    sizes = [len((d[1] or "").encode()) + 1 for d in documents]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d[0], s, zlib.crc32((d[1] or "").encode())) for d, s in zip(documents, sizes))
    for shard in {r.shard for r in got}:
        mine = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in mine) == list(range(len(mine))) and 0 <= shard < 8
    again = sharding.assign_shards(docs.repartition(2), **options).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert sharding.assign_shards(empty).count() == 0


def test_shards_are_near_equal_and_divide_large_groups(spark):
    rows = [(i, "copy " * 50) for i in range(3000)] + [(5000 + i, prose(20 + i % 50, i)) for i in range(6000)] + [(None, "")] * 2000
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), rows_per_range=100)
    sums = [r.s for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 8 and max(sums) <= 1.02 * min(sums)
    cut = got.groupBy("text_crc32").agg(F.countDistinct("shard").alias("k")).where("k > 1").count()
    assert cut == 1  # the copies only


# ---- 10 ----


def jaccard_components(documents, size=4, percent=85):
    sets = defaultdict(set)
    for d in documents:
        if d[0] is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", lower(d[1]))
            s = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
            sets[d[0]].add(s)
    ids = sorted(sets)
    forest = ngram_join.Forest(len(ids))
    for i, a in enumerate(ids):
        for j in range(i):
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[ids[j]]):
                forest.union(i, j)
    return {a: ids[forest.find(i)] for i, a in enumerate(ids)}


@pytest.mark.parametrize("options", [{}, {"cell_shingles": 300}, {"size": 5, "percent": 80}])
def test_jaccard_components(docs, documents, empty, options):
    want = jaccard_components(documents, options.get("size", 4), options.get("percent", 85))
    got = ngram_join.ngram_components(docs, **options).collect()
    assert len(got) == len(documents)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None] * 3
    kept = ngram_join.keep_one(docs, **options)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*set(want.values()), None, None, None])
    assert ngram_join.ngram_components(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_all_links(spark):
    base = prose(100, 30)
    rows = [(i, near(base, i % 3, i)) for i in range(40)] + [(100 + i, prose(100, 100 + i)) for i in range(20)] + [(200, base), (201, base)]
    join = ngram_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), cell_shingles=500)
    sets = {d: ngram_join.shingles(t, 4, {}) for d, t in rows}
    least = {}
    for d, s in sets.items():
        least.setdefault(s.tobytes(), d)
    ids = sorted(least.values())
    want = set()
    for a in ids:
        for b in ids:
            shared = len(np.intersect1d(sets[a], sets[b]))
            if a < b and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                want.add((a, b))
    assert {(r.a, r.b) for r in join.links().collect()} == want and len(want) > 20


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(3, 3), (1049, 2000)]
    rnd.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in [*range(1000, 1050), 2000]}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- queries ----


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_its_definition(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    want = sorted(result.fetchall(), key=repr)
    assert sorted(map(tuple, QUERIES[name](spark, SF).select(*columns).collect()), key=repr) == want


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in entry.queries() if re.match(r"op\d+_", name))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


# ---- pipeline ----


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(77)
    words = [f"v{i}" for i in range(5000)]
    fresh_prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    spaced = lambda text, n: " ".join(f"n{i}" if i % (len(text.split()) // n) == 20 else w for i, w in enumerate(text.split()))
    shared, rare, body, wide = fresh_prose(40), fresh_prose(20), fresh_prose(80), fresh_prose(200)
    texts = [fresh_prose(70) for _ in range(6)]
    texts += [fresh_prose(55) + "\n" + shared for _ in range(5)]
    # Four holders are left when the rules have dropped the fifth, so this line stays.
    texts += [fresh_prose(60) + "\n" + rare for _ in range(4)] + ["again " * 90 + "\n" + rare]
    texts += [body, body + "\n" + shared, fresh_prose(60) + "\n" + shared]  # copies when the line has gone
    texts += [wide, spaced(wide, 4), spaced(wide, 9), texts[0], texts[0]]
    texts += [fresh_prose(60) + " " + ITEM, fresh_prose(400) + " " + " ".join(ITEM.split()[:13])]  # five per cent and less
    texts += [None, "", "too short", "again " * 80]
    docs = [(i + 1, t, "en", None, None if t is None else len(t)) for i, t in enumerate(texts)]
    frames = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([], "doc_id long, quality int, toxic int"),
        "benchmark": (ITEMS, "item_id long, text string"),
    }
    for name, (rows_, schema) in frames.items():
        spark.createDataFrame(rows_, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    # Without labels the forest keeps what the rules keep.
    count = lambda t: (len((t or "").split()), quality.rule_counts(t)[quality.COUNTS.index("n_repeat_words")])
    passed = [d for d in docs if count(d[1])[0] >= 50 and 2 * count(d[1])[1] <= count(d[1])[0]]
    stripped = [(*d[:1], t, *d[2:4], len(t)) for d, (_, t, _, _) in zip(passed, deduped(passed))]
    roots = jaccard_components(stripped, 5, 80)
    single = [d for d in stripped if roots[d[0]] == d[0]]
    clean = [d for d, w in zip(single, contaminated(single, ITEMS)) if not w[-1]]
    # Every stage drops something, and another order or other parameters would show.
    assert len(docs) > len(passed) > len(single) > len(clean) and passed != stripped
    assert roots != jaccard_components(stripped, 4, 85) and roots != jaccard_components(passed, 5, 80)
    assert dict((d[0], t) for d, (_, t, _, _) in zip(docs, deduped(docs))) != dict((d[0], d[1]) for d in docs) | {d[0]: d[1] for d in stripped}
    assert any(rare in d[1] for d in clean) and {d[0] for d in single} - {d[0] for d in clean}

    assert len(corpus_pipeline.STAGES) == 5
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, (passed, stripped, single, clean)):
        at = stage(spark, at, str(tmp_path))
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(map(tuple, at.collect())) == sorted(want), name
    encoded = packing.Encoder(packing.tokenizer_path()).encode([d[1] for d in clean])
    tokens = {d[0]: (*np.frombuffer(ids, np.uint16).tolist(), 1) for d, ids in zip(clean, encoded)}
    for rows_ in (corpus_pipeline.STAGES[4][1](spark, at, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        ends = defaultdict(list)
        for x in rows_.collect():
            assert x.doc_tokens == len(tokens[x.doc_id])
            ends[x.doc_id].append((x.start, x.length, x.ids_crc32))
        assert set(ends) == set(tokens)
        for doc, parts in ends.items():
            place = 0
            for start, length, crc in sorted(parts):
                assert start == place and zlib.crc32(np.array(tokens[doc][start : start + length], "<u4").tobytes()) == crc
                place += length
            assert place == len(tokens[doc])


def test_pages_with_an_article_are_differenced_too(spark):
    """Lines that neighbours share are found on every page; those inside articles come back, the others don't."""
    page = "<body><p>Shared top</p><article><p>Own {0}</p><p>Passage of all</p></article><p>Only here {0}</p></body>"
    rows = [(n, f"https://h.org/a/{n}", page.format(n)) for n in range(3)]
    pages = spark.createDataFrame([(*r[:1], r[0] + 7, *r[1:]) for r in rows], "page_id long, page_key long, url string, html string")
    assert {r.page_id: r.places for r in html_extract.template_lines(pages).collect()} == {n: [0, 2] for n in range(3)}
    texts = {r.page_id: r.text for r in html_extract.extract_pages(pages.drop("page_key")).collect()}
    assert texts == {n: f"Own {n}\nPassage of all" for n in range(3)}
